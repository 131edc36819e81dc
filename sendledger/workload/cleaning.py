"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sendledger.functions import dates as D, text as X
from sendledger.functions.predicates import (
    CHANNEL_DEFAULT, CHANNEL_RULES, PRODUCT_DEFAULT, PRODUCT_RULES, campaign_token, channel_filter,
    label, on_day_tokens,
)
from sendledger.operators.quality import invalid_numbers, length_violations
from sendledger.schemas import STAGED_WIDTHS
from sendledger.workload.registry import head, query

UNQUOTED = "trim(regexp_replace(raw_ts, '^[\"'']|[\"'']$', '', 'g'))"
US_MINUTE = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})$"


def _part(n: int) -> str:
    return f"regexp_extract({UNQUOTED}, '{US_MINUTE}', {n})"


@query(
    "report_timestamps", ("raw_cells",),
    f"""SELECT event_id, CASE WHEN raw_ts IS NULL OR trim(raw_ts) = '' OR contains(lower(raw_ts), 'in process')
    THEN NULL WHEN regexp_matches({UNQUOTED}, '{US_MINUTE}') THEN concat({_part(3)}, '-',
    lpad({_part(1)}, 2, '0'), '-', lpad({_part(2)}, 2, '0'), ' ', lpad({_part(4)}, 2, '0'), ':', {_part(5)}, ':00')
  ELSE {UNQUOTED} END AS submit_time FROM raw_cells""",
)
def _(t):
    return t.raw_cells.select("event_id", D.parse_report_ts(F.col("raw_ts")).alias("submit_time"))


@query(
    "plain_mobiles", ("raw_cells",),
    "SELECT event_id, CASE WHEN contains(raw_mobile, 'E+') THEN CAST(CAST(CAST(raw_mobile AS DOUBLE) "
    "AS DECIMAL(38,0)) AS VARCHAR) ELSE nullif(raw_mobile, '') END AS mobile FROM raw_cells",
)
def _(t):
    return t.raw_cells.select("event_id", X.plain_mobile(F.col("raw_mobile")).alias("mobile"))


@query(
    "clean_ids", ("raw_cells",),
    "SELECT event_id, nullif(replace(trim(raw_txn), '''', ''), '') AS txn, "
    "nullif(replace(trim(raw_tag), '`', ''), '') AS tag FROM raw_cells",
)
def _(t):
    return t.raw_cells.select(
        "event_id", X.clean_txn_id(F.col("raw_txn")).alias("txn"), X.clean_tag_id(F.col("raw_tag")).alias("tag")
    )


@query(
    "leading_numbers", ("raw_cells",),
    r"""SELECT event_id,
  TRY_CAST(nullif(regexp_extract(raw_number, '^\s*([+-]?\d+)', 1), '') AS BIGINT) AS whole,
  TRY_CAST(nullif(regexp_extract(raw_number, '^\s*([+-]?\d+\.?\d*)', 1), '') AS DOUBLE) AS fraction
FROM raw_cells""",
)
def _(t):
    c = F.col("raw_number")
    return t.raw_cells.select("event_id", X.lead_int(c).alias("whole"), X.lead_float(c).alias("fraction"))


VALID = (
    r"CASE WHEN regexp_full_match(trim(raw_entry), '91[6-9]\d{9}') THEN trim(raw_entry) "
    r"WHEN regexp_full_match(trim(raw_entry), '[6-9]\d{9}') THEN concat('91', trim(raw_entry)) END"
)


@query("valid_mobiles", ("raw_cells",), f"SELECT event_id, {VALID} AS mobileNo FROM raw_cells")
def _(t):
    return t.raw_cells.select("event_id", X.normal_mobile(F.col("raw_entry")).alias("mobileNo"))


@query(
    "invalid_numbers", ("raw_cells",),
    f"SELECT event_id, raw_entry FROM raw_cells WHERE trim(raw_entry) <> '' AND {VALID} IS NULL",
)
def _(t):
    return invalid_numbers(t.raw_cells.select("event_id", "raw_entry"), "raw_entry")


LAST = "replace(string_split(path, '/')[-1], '%20', ' ')"


@query(
    "source_names", ("raw_cells",),
    f"SELECT event_id, regexp_replace({LAST}, '\\.csv$', '') AS report, "
    f"regexp_replace({LAST}, '\\.[^.]*$', '') AS list FROM raw_cells",
)
def _(t):
    p = F.col("path")
    return t.raw_cells.select(
        "event_id", X.source_from_path(p).alias("report"), X.source_from_path(p, any_extension=True).alias("list")
    )


@query(
    "name_keys", ("raw_cells",),
    r"SELECT event_id, regexp_replace(raw_name, '\s+', '_', 'g') AS name_key, "
    r"regexp_replace(raw_name, '[-\s]', '_', 'g') AS feed_key FROM raw_cells",
)
def _(t):
    c = F.col("raw_name")
    return t.raw_cells.select("event_id", X.name_key(c).alias("name_key"), X.feed_key(c).alias("feed_key"))


@query(
    "sheet_days", ("raw_days",),
    """SELECT o_orderkey, CASE WHEN contains(sheet_cell, '/') THEN concat(
    CASE WHEN length(string_split(sheet_cell, '/')[3]) = 4 THEN '' ELSE '20' END, string_split(sheet_cell, '/')[3], '-',
    lpad(string_split(sheet_cell, '/')[1], 2, '0'), '-', lpad(string_split(sheet_cell, '/')[2], 2, '0'))
  ELSE sheet_cell END AS day FROM raw_days""",
)
def _(t):
    return t.raw_days.select("o_orderkey", D.sheet_date(F.col("sheet_cell")).alias("day"))


@query(
    "formatted_days", ("raw_days",),
    """SELECT o_orderkey, day AS named, day AS us,
  CASE WHEN regexp_matches(sheet_cell, '^[0-9]{4}-') THEN CAST(sheet_cell AS DATE) END AS iso,
  CAST(second_text AS TIMESTAMP) AS second FROM raw_days""",
)
def _(t):
    return t.raw_days.select(
        "o_orderkey",
        D.try_date(F.col("named_day"), D.DAY_MONTH_NAME, D.ISO_DAY).alias("named"),
        D.try_date(F.col("us_day"), *D.US_DAY).alias("us"),
        D.try_date(F.col("sheet_cell"), D.ISO_DAY).alias("iso"),
        F.try_to_timestamp("second_text", F.lit(D.ISO_SECOND)).cast("timestamp_ntz").alias("second"),
    )


@query(
    "days_in_names", ("raw_days",),
    """SELECT o_orderkey, CASE WHEN contains(filename, '''') THEN strftime(day, '%d/%m/20%y')
    WHEN contains(filename, 'th ') AND TRY_CAST(concat('2024', strftime(day, '-%m-%d')) AS DATE) IS NOT NULL
    THEN strftime(day, '%d/%m/2024') END AS named_day,
  CASE WHEN filename = 'Leads.xlsx' THEN 'Jun' ELSE strftime(day, '%b') END AS named_month FROM raw_days""",
)
def _(t):
    c = F.col("filename")
    return t.raw_days.select(
        "o_orderkey", D.date_in_name(c, 2024).alias("named_day"), D.month_in_name(c, "Jun").alias("named_month")
    )


@query(
    "tail_days", ("raw_days",),
    "SELECT o_orderkey, TRY_CAST(concat('2024-', right(coded, 2), '-', left(right(coded, 4), 2)) AS DATE) "
    "AS tail_day FROM raw_days",
)
def _(t):
    return t.raw_days.select("o_orderkey", D.tail_date(F.col("coded"), 2024).alias("tail_day"))


@query(
    "scrubbed_texts", ("template_rows",),
    "SELECT replace(tempid, '''', '') AS tempid, trim(replace(replace(replace(text, chr(9), ''), chr(10), ''), "
    "chr(13), '')) AS text FROM template_rows",
)
def _(t):
    return t.template_rows.select(
        X.strip_quote(F.col("tempid")).alias("tempid"), X.scrub(F.col("text")).alias("text")
    )


@query(
    "epoch_texts", ("cdr",),
    "SELECT event_id, strftime(epoch_ms(submitTime), '%Y-%m-%d %H:%M:%S') AS submit_time, "
    "strftime(epoch_ms(deliveryTime + 19800000), '%Y-%m-%d %H:%M:%S') AS delivered_time FROM cdr",
)
def _(t):
    return t.cdr.select(
        "event_id", D.ms_to_text(F.col("submitTime")).alias("submit_time"),
        D.ms_to_text(F.col("deliveryTime"), "Asia/Kolkata").alias("delivered_time"),
    )


@query(
    "packed_fields", ("cdr",),
    "SELECT event_id, string_split(additionalData, ',')[:10][-1] AS entity_id, "
    "string_split(additionalData, ',')[:11][-1] AS template_id FROM cdr",
)
def _(t):
    c = F.col("additionalData")
    return t.cdr.select("event_id", X.nth_field(c, 10).alias("entity_id"), X.nth_field(c, 11).alias("template_id"))


@query(
    "name_parts", ("log",),
    f"SELECT message_id, {head('source', '.', 1)} AS name, {head('source', '_', 2)} AS family, "
    f"{head('source', '_', -1)} AS tail FROM log",
)
def _(t):
    c = F.col("source")
    return t.log.select(
        "message_id", X.head_parts(c, ".", 1).alias("name"), X.head_parts(c, "_", 2).alias("family"),
        X.head_parts(c, "_", -1).alias("tail"),
    )


@query(
    "time_parts", ("log",),
    "SELECT message_id, CAST(substr(submit_time, 1, 10) AS DATE) AS day, "
    "CAST(month(CAST(substr(submit_time, 1, 10) AS DATE)) AS INTEGER) AS month, "
    "CAST(year(CAST(substr(submit_time, 1, 10) AS DATE)) AS INTEGER) AS year, "
    "substr(submit_time, 12, 5) AS minute, substr(submit_time, 1, 7) AS part FROM log",
)
def _(t):
    c = F.col("submit_time")
    return t.log.select(
        "message_id", D.day_of(c).alias("day"), F.month(D.day_of(c)).alias("month"),
        F.year(D.day_of(c)).alias("year"),
        F.date_format(c.try_cast("timestamp_ntz"), "HH:mm").alias("minute"), D.month_of(c).alias("part"),
    )


@query(
    "product_labels", ("log",),
    "SELECT message_id, CASE WHEN source LIKE '%CM_LB%' THEN 'LB' WHEN source LIKE '%CM_LH%' THEN 'LH' "
    "WHEN source LIKE '%CM_MX%' THEN 'MX' WHEN source LIKE '%HN_%' THEN 'HN' ELSE 'OTHERS' END AS product_key FROM log",
)
def _(t):
    return t.log.select("message_id", label(F.col("source"), PRODUCT_RULES, PRODUCT_DEFAULT).alias("product_key"))


CHANNEL = (
    "CASE WHEN utm_campaign ILIKE '%RC_J%' THEN 'JIO' WHEN utm_campaign ILIKE '%RC%' THEN 'RCS' "
    "WHEN utm_campaign ILIKE '%SM%' THEN 'SMS' ELSE 'OTHERS' END"
)


def token_sql(*marks: str) -> str:
    cases = " ".join(
        f"WHEN utm_campaign ILIKE '%{m}%' THEN string_split(string_split(utm_campaign, '{m}')[-1], '_')[1]"
        for m in marks
    )
    return f"CASE {cases} ELSE right(utm_campaign, 4) END"


@query("channel_labels", ("funnel_base",), f"SELECT row_id, {CHANNEL} AS campaign_type FROM funnel_base")
def _(t):
    return t.funnel_base.select(
        "row_id", label(F.col("utm_campaign"), CHANNEL_RULES, CHANNEL_DEFAULT).alias("campaign_type")
    )


@query(
    "campaign_tokens", ("funnel_base",),
    f"SELECT row_id, {token_sql('_RC_', '_RC_J_', '_SM_')} AS token, "
    f"{token_sql('_RC_J_', '_RC_', '_SM_')} AS fixed_token FROM funnel_base",
)
def _(t):
    c = F.col("utm_campaign")
    return t.funnel_base.select(
        "row_id", campaign_token(c).alias("token"), campaign_token(c, fixed=True).alias("fixed_token")
    )


# 28 February to 2 March of a leap year.
TOKENS = "2802|0228|2902|0229|0103|0301|0203|0302"


@query(
    "campaigns_of_days", ("funnel_base",),
    f"SELECT row_id, utm_campaign FROM funnel_base WHERE regexp_matches(utm_campaign, '{TOKENS}')",
)
def _(t):
    return t.funnel_base.where(
        on_day_tokens(F.col("utm_campaign"), "2024-02-28", "2024-03-02")
    ).select("row_id", "utm_campaign")


for _name, _condition in {
    "SMS": "utm_campaign ILIKE '%SM%'",
    "RCS": "utm_campaign ILIKE '%RC%' AND utm_campaign NOT ILIKE '%RC_J%'",
    "JIO": "utm_campaign ILIKE '%RC_J%'",
    "All": "TRUE",
}.items():

    @query(
        f"channel_{_name.lower()}", ("funnel_base",),
        f"SELECT row_id, utm_campaign FROM funnel_base WHERE {_condition}",
    )
    def _(t, name=_name):
        return t.funnel_base.where(channel_filter(F.col("utm_campaign"), name)).select("row_id", "utm_campaign")


LIMITS = {**{n: w for n, w in STAGED_WIDTHS.items() if n != "text"}, "cause": 20, "mobileNo": 11}


@query(
    "length_violations", ("staged",),
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, {w} AS max_length, count(CASE WHEN length({n}) > {w} THEN 1 END) AS violations, "
        f"CAST(max(length({n})) AS INTEGER) AS longest FROM staged"
        for n, w in LIMITS.items()
    ) + ") t WHERE violations > 0",
)
def _(t):
    return length_violations(t.staged, LIMITS)
