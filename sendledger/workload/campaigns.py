"""Campaign reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sendledger.functions.predicates import any_like, by, is_dnd, on_days
from sendledger.operators import reports as R
from sendledger.operators.paging import page, page_info
from sendledger.sources.store import distinct_values, read_months
from sendledger.workload.registry import Inputs, head, query

START, END = "2024-01-05", "2024-05-20"
DAY = "2024-03-10"
SENDER, CLIENT = "senda", "client 2"

DELIVERED = "lower(status) IN ('delivered', '000', '0')"
FAILED = "lower(cause) NOT IN ('delivered', '000', '0', 'ncpr fail')"
SUBMIT_DAY = "CAST(substr(submit_time, 1, 10) AS DATE)"
PROMO_DAY = "CAST(substr(date, 1, 10) AS DATE)"


def measures(names: tuple[str, str, str, str]) -> str:
    a, b, c, d = names
    return (
        f"count(status) AS {a}, CAST(sum(CASE WHEN {DELIVERED} THEN 1 ELSE 0 END) AS BIGINT) AS {b}, "
        f"CAST(sum(CASE WHEN lower(cause) = 'ncpr fail' THEN 1 ELSE 0 END) AS BIGINT) AS {c}, "
        f"CAST(sum(CASE WHEN {FAILED} THEN 1 ELSE 0 END) AS BIGINT) AS {d}"
    )


COUNTS = measures(("submitted_count", "delivered_count", "notsent_count", "failed_count"))
TOTALS = measures(("total_submitted", "total_delivered", "total_notsent", "total_failed"))
IN_RANGE = f"{SUBMIT_DAY} BETWEEN DATE '{START}' AND DATE '{END}'"
PROMO_RANGE = f"{PROMO_DAY} BETWEEN DATE '{START}' AND DATE '{END}'"
PRODUCT = (
    "CASE WHEN raw LIKE '%CM_LB%' THEN 'LB' WHEN raw LIKE '%CM_LH%' THEN 'LH' "
    "WHEN raw LIKE '%CM_MX%' THEN 'MX' WHEN raw LIKE '%HN_%' THEN 'HN' ELSE 'OTHERS' END"
)


def _summary_sql(key: str, where: str = IN_RANGE) -> str:
    return f"""SELECT {PRODUCT} AS product_key, circle, {head('raw', '.', 1)} AS source, date,
  submitted_date, product_name, submitted_count, delivered_count, notsent_count, failed_count
FROM (SELECT {key} AS raw, circle, substr(submit_time, 1, 16) AS date, {SUBMIT_DAY} AS submitted_date,
  min(sender) AS product_name, {COUNTS}
FROM log WHERE sender = 'SENDA' AND {where} GROUP BY 1, 2, 3, 4) t"""


@query("campaign_summary", ("log",), _summary_sql("source"))
def _(t: Inputs) -> DataFrame:
    return R.campaign_summary(read_months(t.log, START, END), SENDER, START, END)


@query("campaign_summary_collapsed", ("log",), _summary_sql(head("source", ".", 1)))
def _(t):
    return R.campaign_summary(t.log, SENDER, START, END, collapse=True)


@query("campaign_summary_one_day", ("log",), _summary_sql("source", f"{SUBMIT_DAY} = DATE '2024-01-12'"))
def _(t):
    return R.campaign_summary(t.log, SENDER, start="2024-01-12")


@query("campaign_summary_all_days", ("log",), _summary_sql("source", "TRUE"))
def _(t):
    return R.campaign_summary(t.log, SENDER)


@query("counters_by_sender", ("log",), f"SELECT sender, {COUNTS} FROM log GROUP BY sender")
def _(t):
    return R.counts_by(t.log, "sender")


@query("counts_per_source", ("staged",), f"SELECT source, {COUNTS} FROM staged GROUP BY source")
def _(t):
    return R.counts_by(t.staged, "source")


@query(
    "source_group_totals", ("log",),
    f"SELECT {head('source', '_', 2)} AS source_group, {TOTALS} FROM log "
    f"WHERE sender = 'SENDA' AND {IN_RANGE} GROUP BY 1",
)
def _(t):
    return R.group_totals(read_months(t.log, START, END), SENDER, START, END)


@query(
    "undelivered_causes", ("log",),
    f"SELECT {head('raw', '.', 1)} AS source, cause, total_failed FROM (SELECT source AS raw, cause, "
    "count(*) AS total_failed FROM log WHERE lower(status) <> 'delivered' GROUP BY source, cause) t",
)
def _(t):
    return R.undelivered_causes(t.log)


@query(
    "cause_ranking", ("log",),
    f"SELECT cause, count(*) AS total_failed FROM log WHERE {IN_RANGE} GROUP BY cause",
)
def _(t):
    return R.cause_ranking(t.log, START, END)


UPLOADS = f"""SELECT vendor, product, substr(date, 1, 10) AS date, source, channel, client,
  count(mobileNo) AS mobile_count FROM promo
WHERE {PROMO_RANGE} AND client ILIKE '%client%' GROUP BY ALL"""


@query("upload_list", ("promo",), UPLOADS)
def _(t):
    return R.upload_list(read_months(t.promo, START, END), "client", START, END)


SOURCE_COUNT = (
    f"SELECT CAST(sum(n) AS BIGINT) AS total_records FROM (SELECT month, count(DISTINCT source) AS n "
    f"FROM promo WHERE {PROMO_RANGE} AND client ILIKE '%client%' GROUP BY month) t"
)


@query("source_count", ("promo",), SOURCE_COUNT)
def _(t):
    return R.source_count(read_months(t.promo, START, END), "client", START, END)


@query(
    "message_texts", ("log",),
    "SELECT DISTINCT substr(submit_time, 1, 10) AS date, text, product FROM log WHERE month = '2024-03'",
)
def _(t):
    return R.message_texts(t.log, "2024-03")


@query(
    "message_texts_by_group", ("log",),
    f"SELECT date, {head('raw', '_', 2)} AS source, text, product FROM (SELECT DISTINCT "
    "substr(submit_time, 1, 10) AS date, source AS raw, text, product FROM log) t",
)
def _(t):
    return R.message_texts(t.log, by_group=True)


DONE_RANGE = "lower(client) = 'client 2' AND substr(date, 1, 10) BETWEEN '2024-05-03' AND '2024-05-28'"


@query(
    "base_check", ("done",),
    "SELECT DISTINCT substr(date, 1, 10) AS date, channel, sender, source, base, product, client "
    f"FROM done WHERE {DONE_RANGE}",
)
def _(t):
    return R.base_check(read_months(t.done, "2024-05-03", "2024-05-28"), CLIENT, "2024-05-03", "2024-05-28")


@query(
    "day_circle_status", ("done",),
    "SELECT substr(date, 1, 10) AS date, circle, count(*) AS total, "
    "count(CASE WHEN lower(status) = 'delivered' THEN 1 END) AS delivered_count, "
    "count(CASE WHEN lower(status) = 'failed' THEN 1 END) AS failed_count, "
    "count(CASE WHEN lower(status) = 'notsent' THEN 1 END) AS notsent_count "
    f"FROM done WHERE {DONE_RANGE} GROUP BY 1, 2",
)
def _(t):
    return R.day_circle_status(t.done, CLIENT, "2024-05-03", "2024-05-28")


@query(
    "day_upload_status", ("promo",),
    f"SELECT count(DISTINCT source) > 0 AS uploaded, DATE '{DAY}' AS date, "
    f"count(DISTINCT source) AS source_count, count(*) * 1024 AS size_in_bytes "
    f"FROM promo WHERE {PROMO_DAY} = DATE '{DAY}'",
)
def _(t):
    return R.day_status(t.promo, DAY)


@query("day_files", ("promo",), f"SELECT DISTINCT source FROM promo WHERE {PROMO_DAY} = DATE '{DAY}'")
def _(t):
    return R.day_files(t.promo, DAY)


@query("day_totals", ("log",), f"SELECT {TOTALS} FROM log WHERE {SUBMIT_DAY} = DATE '{DAY}'")
def _(t):
    return R.day_totals(t.log, DAY)


@query("day_totals_no_rows", ("log",), f"SELECT {TOTALS} FROM log WHERE {SUBMIT_DAY} = DATE '2031-01-01'")
def _(t):
    return R.day_totals(t.log, "2031-01-01")


@query(
    "delivered_by_circle", ("log",),
    "SELECT circle, count(status) AS count FROM log WHERE lower(status) = 'delivered' "
    f"AND {SUBMIT_DAY} = DATE '{DAY}' GROUP BY circle",
)
def _(t):
    return R.delivered_by_circle(t.log, DAY)


@query(
    "monthly_trend", ("log",),
    f"SELECT CAST(year({SUBMIT_DAY}) AS INTEGER) AS year, CAST(month({SUBMIT_DAY}) AS INTEGER) AS month, "
    f"CAST(sum(CASE WHEN {DELIVERED} THEN 1 ELSE 0 END) AS BIGINT) AS total_delivered "
    "FROM log WHERE lower(status) = 'delivered' GROUP BY 1, 2",
)
def _(t):
    return R.monthly_trend(t.log)


@query(
    "daily_trend", ("log",),
    f"SELECT date, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, "
    f"delivered_count FROM (SELECT {SUBMIT_DAY} AS date, count(*) AS delivered_count FROM log "
    "WHERE lower(status) = 'delivered' GROUP BY 1) t",
)
def _(t):
    return R.daily_trend(t.log)


@query(
    "campaign_combinations", ("done",),
    f"SELECT DISTINCT substr(date, 1, 10) AS date, channel, base, product FROM done WHERE {DONE_RANGE}",
)
def _(t):
    return R.campaign_combinations(t.done, CLIENT, "2024-05-03", "2024-05-28")


@query("clients", ("promo",), f"SELECT DISTINCT client FROM promo WHERE {PROMO_RANGE}")
def _(t):
    return R.clients(read_months(t.promo, START, END), START, END)


@query("distinct_clients", ("product_mapping",), "SELECT DISTINCT client FROM product_mapping")
def _(t):
    return distinct_values(t.product_mapping, "client")


@query(
    "distinct_senders", ("product_mapping",),
    "SELECT DISTINCT sender FROM product_mapping WHERE channel = 'sms'",
)
def _(t):
    return distinct_values(t.product_mapping, "sender", "SMS")


@query("products_of_channel", ("product_mapping",), "SELECT * FROM product_mapping WHERE channel = 'rcs'")
def _(t):
    return by(t.product_mapping, channel="RCS")


@query("mapping_of_client", ("product_mapping",), "SELECT * FROM product_mapping WHERE client = 'Client 3'")
def _(t):
    return by(t.product_mapping, client="CLIENT 3")


@query(
    "month_range", ("log",),
    "SELECT message_id, month FROM log WHERE month BETWEEN '2024-01' AND '2024-04'",
)
def _(t):
    return read_months(t.log, "2024-01-31", "2024-04-01").select("message_id", "month")


@query("day_range", ("log",), f"SELECT message_id, submit_time FROM log WHERE {IN_RANGE}")
def _(t):
    return on_days(t.log, R.submit_day(t.log), START, END).select("message_id", "submit_time")


@query(
    "like_any", ("log",),
    "SELECT message_id, source FROM log WHERE source ILIKE '%cm_l_%' OR client ILIKE '%3' OR text ILIKE 'offer 1%'",
)
def _(t):
    return t.log.where(
        any_like(F.col("source"), ["%cm_l_%"]) | any_like(F.col("client"), ["%3"])
        | any_like(F.col("text"), ["OFFER 1%"])
    ).select("message_id", "source")


@query(
    "do_not_disturb_causes", ("log",),
    "SELECT message_id, cause FROM log WHERE cause LIKE '%blocked in preferences with msisdn as pk.%' "
    "OR cause LIKE '%reserved for preference%' OR cause LIKE '%NCPR Fail%'",
)
def _(t):
    return t.log.where(is_dnd(F.col("cause"))).select("message_id", "cause")


def _page_sql(condition: str, order: str) -> str:
    return (
        f"SELECT * FROM ({UPLOADS}) u WHERE source IN (SELECT source FROM (SELECT DISTINCT source "
        f"FROM ({UPLOADS}) v) w WHERE {condition} ORDER BY source {order} LIMIT 10)"
    )


def _uploads(t: Inputs) -> DataFrame:
    return R.upload_list(t.promo, "client", START, END)


@query("first_page", ("promo",), _page_sql("TRUE", "ASC"))
def _(t):
    return page(_uploads(t))


@query("next_page", ("promo",), _page_sql("source > 'CM_LB_1501.0'", "ASC"))
def _(t):
    return page(_uploads(t), "CM_LB_1501.0")


@query("previous_page", ("promo",), _page_sql("source < 'CM_MX_0901.0'", "DESC"))
def _(t):
    return page(_uploads(t), "CM_MX_0901.0", direction="prev")


@query(
    "page_info", ("promo",),
    f"""SELECT c.total_records, CAST(ceil(c.total_records / 10.0) AS BIGINT) AS total_pages,
  'Next' AS current_page, p.a AS first_page_cursor, p.z AS last_page_cursor, p.a AS previous_cursor,
  p.z AS next_cursor, p.n = 10 AS has_next, TRUE AS has_previous
FROM ({SOURCE_COUNT}) c, (SELECT min(source) AS a, max(source) AS z, count(*) AS n FROM
  (SELECT DISTINCT source FROM ({UPLOADS}) v WHERE source > 'CM_LB_1501.0' ORDER BY source LIMIT 10) s) p""",
)
def _(t):
    return page_info(t.promo, "client", START, END, cursor="CM_LB_1501.0")
