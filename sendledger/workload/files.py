"""Queries that write the sample rows as input files, then read and load them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sendledger.operators.reports import campaign_summary
from sendledger.plans.ingest import DND, DONE, LOG, PROMO, Store, ingest, ingest_cdr, ingest_numbers
from sendledger.schemas import FEEDS, STAGED_COLUMNS
from sendledger.session import settle, work_folder
from sendledger.sources.feeds import read_feed, read_templates
from sendledger.sources.reports import read_delivery_reports, read_number_list
from sendledger.sources.store import read_cdr, write_cdr
from sendledger.streaming.watch import hourly_counts, keep_counts, kept_counts, running_counts, stream_table, watch_reports
from sendledger.workload.campaigns import COUNTS, END, IN_RANGE, START
from sendledger.workload.loads import CAMPAIGN, CLIENT_MAP, REGION, SENDER_MAP
from sendledger.workload.registry import CSV, Inputs, query

FILE_HEADERS = {
    "Transaction_ID": "transaction_id", "Message ID": "message_id", "Mobile": "mobileNo",
    "Sender_Name": "sender", "Text_Message": "text", "Type": "type", "Length": "length",
    "Cost": "cost", "Status": "status", "Cause": "cause", "Channel_Name": "channel_name",
    "Submitted_Time": "submit_time", "Delivered_Time": "delivered_time", "IP": "ip",
    "EntityId": "entity_id", "TemplateId": "template_id",
}
FIXED = {"client": "Client 1", "product": "Product 1", "base": "base1", "vendor": "vendor1", "channel": "sms"}


def _write_reports(t: Inputs) -> list[str]:
    """Delivery reports in two layouts: the second in reverse order with one more column."""
    folder = work_folder(t.spark)
    names = list(FILE_HEADERS)
    rows = t.staged.withColumn("text", F.concat("text", F.lit(' "now",\nor later')))
    # A stray quote: the writer quotes no cell for it, so it stands bare inside the cell.
    rows = rows.withColumn("channel_name", F.concat("channel_name", F.lit(' 3" pipe')))
    cells = rows.select([F.col(FILE_HEADERS[n]).alias(n) for n in names])
    delivered = F.lower(F.col("Status")).isin("delivered", "000")
    cells.where(delivered).write.options(**CSV).csv(f"{folder}/first")
    other = cells.where(~F.coalesce(delivered, F.lit(False))).withColumn("Extra", F.lit("x"))
    other.select("Extra", *reversed(names)).write.options(**CSV).csv(f"{folder}/second")
    return [f"{folder}/first", f"{folder}/second"]


STRAY = "concat(channel_name, ' 3\" pipe') AS channel_name"
TEXT = "concat(text, ' \"now\",', chr(10), 'or later') AS text"
READ_ROWS = f"""SELECT transaction_id, message_id, mobileNo, sender, {TEXT}, type, length, cost,
  coalesce(status, '') AS status, coalesce(cause, '') AS cause, {STRAY}, submit_time, delivered_time, ip,
  entity_id, template_id, 'Client 1' AS client, 'Product 1' AS product, 'base1' AS base, 'Unknown' AS circle,
  'vendor1' AS vendor, 'sms' AS channel, 'part' AS source FROM staged"""


def _plain_source(df: DataFrame) -> DataFrame:
    """Spark's own file names cut to what is known beforehand."""
    return df.withColumn("source", F.regexp_replace("source", "^part-[0-9].*$", "part"))


@query("read_delivery_reports", ("staged",), READ_ROWS)
def _(t):
    return _plain_source(read_delivery_reports(t.spark, _write_reports(t), FIXED)[0]).select(STAGED_COLUMNS)


@query(
    "rejected_reports", ("staged",),
    "SELECT list_sort(['cause', 'status', 'text_message']) AS missing, 'missing columns' AS reason "
    "FROM (SELECT count(*) AS n FROM staged) s WHERE n > 0",
)
def _(t):
    folder = work_folder(t.spark)
    names = [n for n in FILE_HEADERS if n not in ("Cause", "Status", "Text_Message")]
    rows = t.staged.select([F.col(FILE_HEADERS[n]).alias(n) for n in names])
    rows.write.options(**CSV).csv(folder)
    rejected = read_delivery_reports(t.spark, folder, FIXED)[1]
    return rejected.select(F.array_sort("missing").alias("missing"), "reason").distinct()


LIST_NUMBERS = """SELECT mobileNo, 'e' AS status, 'e' AS cause, 'NA' AS text, 'SENDA' AS sender, '2024-03-10' AS submit_time
FROM staged UNION ALL SELECT mobileNo, 'e', 'e', 'NA', 'SENDA', '2024-03-10' FROM staged"""


def _write_numbers(t: Inputs) -> str:
    """Every number with and without its country code, plus junk, commas and blanks between."""
    folder = work_folder(t.spark)
    number = F.col("mobileNo")
    line = F.concat_ws(",", F.concat(F.lit(" "), number), F.substring(number, 3, 10), F.lit(" "), F.lit("12x"))
    t.staged.select(line).write.text(folder)
    return folder


LIST_CAMPAIGN = {**FIXED, "sender": "SENDA", "date": "2024-03-10"}


@query("read_number_list", ("staged",), LIST_NUMBERS)
def _(t):
    rows, _invalid = read_number_list(t.spark, _write_numbers(t), LIST_CAMPAIGN)
    return rows.select("mobileNo", "status", "cause", "text", "sender", "submit_time")


@query(
    "read_number_list_on_one_line", ("staged",),
    "SELECT mobileNo, 'SENDA' AS sender, '2024-03-10' AS submit_time FROM staged",
)
def _(t):
    folder = work_folder(t.spark)
    t.staged.select("mobileNo").write.option("lineSep", ",").text(folder)
    rows, _invalid = read_number_list(t.spark, folder, LIST_CAMPAIGN)
    return rows.select("mobileNo", "sender", "submit_time")


@query("invalid_list_entries", ("staged",), "SELECT '12x' AS entry, count(*) AS n FROM staged")
def _(t):
    _rows, invalid = read_number_list(t.spark, _write_numbers(t), LIST_CAMPAIGN)
    return invalid.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))


def _sheet(t: Inputs, feed: str, kind: str, filled: dict[str, F.Column], rows: DataFrame) -> str:
    folder = work_folder(t.spark)
    names = FEEDS[(feed, kind)]
    rows.select([filled.get(n, F.lit("")).alias(n) for n in names]).write.options(**CSV).csv(folder)
    return folder


@query(
    "read_feed_a", ("lead_feed_a",),
    # A sheet's short year always becomes 20YY.
    "SELECT CAST(strftime(report_date, '20%y-%m-%d') AS DATE) AS report_date, phone, coalesce(utm_medium, '') AS utm_medium, 'Pune, West' AS city, amount FROM lead_feed_a",
)
def _(t):
    filled = {
        "report_date": F.date_format("report_date", "M/d/yy"), "phone": F.col("phone"),
        "utm_medium": F.col("utm_medium"), "city": F.lit("Pune, West"), "amount": F.col("amount"),
    }
    path = _sheet(t, "A", "sales", filled, t.lead_feed_a)
    return read_feed(t.spark, path, "A", "sales").select("report_date", "phone", "utm_medium", "city", "amount")


@query(
    "read_feed_b", ("lead_feed_b",),
    "SELECT lead_date, lead_id, camp_type, coalesce(lead_category, '') AS lead_category, "
    "CAST(lead_date AS TIMESTAMP) + INTERVAL 5 HOUR AS first_date FROM lead_feed_b",
)
def _(t):
    filled = {
        "lead_date": F.date_format("lead_date", "dd-MMM-yy"), "lead_id": F.col("lead_id"),
        "camp_type": F.col("camp_type"), "lead_category": F.col("lead_category"),
        "first_date": F.date_format(F.expr("CAST(lead_date AS TIMESTAMP) + INTERVAL 5 HOURS"), "yyyy-MM-dd HH:mm:ss"),
    }
    path = _sheet(t, "B", "leads", filled, t.lead_feed_b)
    return read_feed(t.spark, path, "B", "leads").select("lead_date", "lead_id", "camp_type", "lead_category", "first_date")


@query(
    "read_feed_c", ("raw_days",),
    "SELECT CAST(o_orderkey AS VARCHAR) AS offer_id, coded AS utm_campaign, day AS campaign_date, "
    "day AS login_date, 'x' AS ticket_size FROM raw_days",
)
def _(t):
    filled = {
        "offer_id": F.col("o_orderkey"), "utm_campaign": F.col("coded"), "campaign_date": F.col("us_day"),
        "login_date": F.date_format("day", "M/d/yy"), "ticket_size": F.lit("x"),
    }
    path = _sheet(t, "C", "leads", filled, t.raw_days)
    return read_feed(t.spark, path, "C", "leads").select("offer_id", "utm_campaign", "campaign_date", "login_date", "ticket_size")


@query(
    "read_templates", ("template_rows",),
    "SELECT tempid, sender, count, replace(text, concat(chr(13), chr(10)), chr(10)) AS text FROM template_rows",
)
def _(t):
    folder = work_folder(t.spark)
    t.template_rows.select(
        F.col("text").alias("Text"), F.col("tempid").alias("TemplateId"), F.col("sender").alias("Sender"),
        F.col("count").alias("Count"),
    ).write.options(**CSV).csv(folder)
    return read_templates(t.spark, folder)


def _loaded_twice(t: Inputs) -> Store:
    """The reports loaded, then sent again: the second load adds nothing."""
    store = Store(t.spark, work_folder(t.spark))
    rows, _rejected = read_delivery_reports(t.spark, _write_reports(t), FIXED)
    rows = settle(rows)  # parsed once for both loads
    for _ in range(2):
        ingest(rows, store, t.product_mapping, t.region_all)
    return store


JOINED = f"""SELECT s.* REPLACE (coalesce(status, '') AS status, coalesce(cause, '') AS cause,
  CASE WHEN r.series IS NOT NULL THEN r.c ELSE circle END AS circle, {TEXT}, {STRAY}, 'part' AS source,
  'Client 1' AS client, 'Product 1' AS product, 'base1' AS base, 'vendor1' AS vendor, 'sms' AS channel),
  substr(submit_time, 1, 7) AS month, CAST(substr(submit_time, 1, 10) AS DATE) AS submit_date,
  coalesce(a.v, sender) AS mapping_key, coalesce((SELECT v FROM {CLIENT_MAP} m WHERE m.s = 'Client 1'), 'Client_1') AS done_key
FROM staged s LEFT JOIN {REGION} r ON substr(mobileNo, 3, 4) = r.series LEFT JOIN {SENDER_MAP} a ON a.s = sender"""
LOAD_USES = ("staged", "region_all", "product_mapping")


def _names(table) -> str:
    return ", ".join(table.schema.names)


@query("ingest_message_log", LOAD_USES, f"SELECT {_names(LOG)} FROM ({JOINED}) j")
def _(t):
    return _plain_source(_loaded_twice(t).read(LOG))


@query(
    "ingest_dnd", LOAD_USES,
    f"SELECT {_names(DND)} FROM (SELECT * REPLACE (cause AS status), submit_time AS date FROM ({JOINED}) j) k WHERE "
    "cause ILIKE '%blocked in preferences with msisdn as pk.%' OR cause ILIKE '%reserved for preference%' "
    "OR cause ILIKE '%NCPR Fail%'",
)
def _(t):
    return _plain_source(_loaded_twice(t).read(DND))


@query(
    "ingest_campaign_table", LOAD_USES,
    f"SELECT {_names(DONE)} FROM (SELECT *, submit_time AS date FROM ({JOINED}) j) k",
)
def _(t):
    return _plain_source(_loaded_twice(t).read(DONE))


@query(
    "ingest_promotions_log", LOAD_USES,
    f"SELECT {_names(PROMO)} FROM (SELECT *, delivered_time AS date, "
    f"CAST(substr(delivered_time, 1, 10) AS DATE) AS delivered_date FROM ({JOINED}) j) k",
)
def _(t):
    return _plain_source(_loaded_twice(t).read(PROMO))


@query(
    "ingest_number_list", ("staged", "region_all"),
    f"""SELECT n.mobileNo, 'e' AS status, '2024-03-10' AS date, CASE WHEN r.series IS NOT NULL THEN r.c ELSE 'Unknown' END
  AS circle, '2024-03' AS month FROM (SELECT mobileNo FROM staged UNION ALL SELECT mobileNo FROM staged) n
LEFT JOIN {REGION} r ON substr(n.mobileNo, 3, 4) = r.series""",
)
def _(t):
    store = Store(t.spark, work_folder(t.spark))
    rows, _invalid = read_number_list(t.spark, _write_numbers(t), LIST_CAMPAIGN)
    for _ in range(2):
        ingest_numbers(rows, store, t.product_mapping, t.region_all, LIST_CAMPAIGN["date"])
    return store.read(DONE).select("mobileNo", "status", "date", "circle", "month")


@query(
    "ingest_call_details", ("cdr", "region_all"),
    f"""SELECT msgId AS message_id, mobileNo, CASE WHEN r.series IS NOT NULL THEN r.c ELSE 'NA' END AS circle,
  strftime(epoch_ms(submitTime), '%Y-%m-%d %H:%M:%S') AS submit_time, 'recovered' AS source, '2024-01' AS month
FROM cdr LEFT JOIN {REGION} r ON substr(mobileNo, 3, 4) = r.series
WHERE cdr_date = DATE '2024-01-12' AND msgId IN
  (SELECT msgId FROM cdr WHERE cdr_date = DATE '2024-01-12' AND uuId = 'u7')""",
)
def _(t):
    folder = work_folder(t.spark)
    write_cdr(t.cdr.drop("event_id"), f"{folder}/cdr")
    day = read_cdr(t.spark, f"{folder}/cdr", "2024-01-12")
    store = Store(t.spark, folder)
    for _ in range(2):
        ingest_cdr(day, "u7", CAMPAIGN, store, t.product_mapping, t.region_all, t.error_codes)
    return store.read(LOG).select("message_id", "mobileNo", "circle", "submit_time", "source", "month")


def _watched(t: Inputs) -> Store:
    """A landing folder drained by the stream, file by file."""
    folder = work_folder(t.spark)
    names = list(FILE_HEADERS)
    t.staged.select([F.col(FILE_HEADERS[n]).alias(n) for n in names]).repartition(3, "source").write.options(
        **CSV
    ).csv(f"{folder}/landing")
    store = Store(t.spark, f"{folder}/store")
    watch_reports(
        t.spark, f"{folder}/landing", store, f"{folder}/checkpoint", FIXED, t.product_mapping,
        t.region_all, files_per_batch=2,
    ).awaitTermination()
    return store


@query(
    "watched_log", LOAD_USES,
    f"SELECT {_names(LOG)} FROM ({JOINED.replace(TEXT, 'text AS text').replace(STRAY, 'channel_name AS channel_name')}) j",
)
def _(t):
    return _plain_source(_watched(t).read(LOG))


@query(
    "watched_summary", ("log", "region_all"),
    f"""SELECT CASE WHEN r.series IS NOT NULL THEN r.c ELSE circle END AS circle, substr(submit_time, 1, 16) AS date, {COUNTS}
FROM (SELECT * REPLACE (coalesce(status, '') AS status, coalesce(cause, '') AS cause) FROM log) log
LEFT JOIN {REGION} r ON substr(mobileNo, 3, 4) = r.series WHERE sender = 'SENDA' AND {IN_RANGE} GROUP BY 1, 2""",
)
def _(t):
    log = _watched(t).read(LOG)
    rows = campaign_summary(log.withColumn("source", F.lit("all")), "SENDA", START, END)
    return rows.select("circle", "date", "submitted_count", "delivered_count", "notsent_count", "failed_count")


@query("running_counts", ("staged",), f"SELECT source, {COUNTS} FROM staged GROUP BY source")
def _(t):
    folder = work_folder(t.spark)
    t.staged.repartition(4, "message_id").write.parquet(f"{folder}/log")
    counted = running_counts(stream_table(t.spark, f"{folder}/log", t.staged.schema, files_per_batch=2))
    keep_counts(counted, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return kept_counts(t.spark, f"{folder}/counts", counted.schema)


@query(
    "hourly_counts", ("staged",),
    f"""SELECT * FROM (SELECT source, concat(substr(submit_time, 1, 13), ':00') AS hour, {COUNTS} FROM staged GROUP BY 1, 2) h
WHERE CAST(concat(hour, ':00') AS TIMESTAMP) + INTERVAL 1 HOUR <=
  (SELECT max(CAST(submit_time AS TIMESTAMP)) - INTERVAL 2 DAY FROM staged)""",
)
def _(t):
    """The hours closed two days after the last row; all files come in one batch, so no row is late."""
    folder = work_folder(t.spark)
    t.staged.write.parquet(f"{folder}/log")
    counted = hourly_counts(stream_table(t.spark, f"{folder}/log", t.staged.schema, files_per_batch=1000))
    rows = counted.select("source", F.date_format("hour.start", "yyyy-MM-dd HH:00").alias("hour"), *counted.columns[2:])
    rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True
    ).start(f"{folder}/closed").awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{folder}/closed")
