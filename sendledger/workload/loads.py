"""Joins, load steps and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sendledger.functions.dates import month_in_name
from sendledger.functions.predicates import by
from sendledger.operators import enrich as E, existence as X, mapping as M, quality as Q
from sendledger.operators.templates import refresh_templates
from sendledger.plans import ingest as I
from sendledger.plans.feeds import append_feed, first_per_phone
from sendledger.plans.tables import change_mappings, load_templates, save_mappings
from sendledger.schemas import MAPPING, TEMPLATES
from sendledger.session import work_folder
from sendledger.sources.store import files_for_month, ledger_filter, read_cdr, read_current, replace_table, write_cdr
from sendledger.workload.registry import CSV, Inputs, query

REGION = "(SELECT series, min(circle) AS c FROM region_all GROUP BY series)"


@query(
    "with_circle", ("staged", "region_all"),
    f"SELECT message_id, mobileNo, CASE WHEN r.series IS NOT NULL THEN r.c ELSE circle END AS circle "
    f"FROM staged LEFT JOIN {REGION} r ON substr(mobileNo, 3, 4) = r.series",
)
def _(t):
    return E.with_circle(t.staged, t.region_all).select("message_id", "mobileNo", "circle")


# Two circles for every series: the smaller name counts and no row is added.
@query(
    "with_circle_twice", ("staged", "region_all"),
    f"SELECT message_id, CASE WHEN r.series IS NOT NULL THEN concat('A ', r.c) ELSE circle END AS circle "
    f"FROM staged LEFT JOIN {REGION} r ON substr(mobileNo, 3, 4) = r.series",
)
def _(t):
    region = t.region_all
    twice = region.unionByName(region.withColumn("circle", F.concat(F.lit("A "), "circle")))
    return E.with_circle(t.staged, twice).select("message_id", "circle")


CODES = (
    "(SELECT code, s.status AS new_status, s.cause AS new_cause FROM (SELECT code, "
    "min({'status': status, 'cause': cause}) AS s FROM error_codes GROUP BY code) x)"
)


@query(
    "with_error_text", ("cdr", "error_codes"),
    f"""SELECT event_id, CASE WHEN m.code IS NULL THEN globalErrorCode ELSE m.new_status END AS status,
  CASE WHEN m.code IS NULL THEN globalErrorCode ELSE m.new_cause END AS cause
FROM cdr LEFT JOIN {CODES} m ON globalErrorCode = m.code""",
)
def _(t):
    code = F.col("globalErrorCode")
    rows = t.cdr.select("event_id", code.alias("status"), code.alias("cause"))
    return E.with_error_text(rows, t.error_codes)


@query(
    "with_error_text_of_one", ("cdr", "error_codes"),
    f"""SELECT event_id, CASE WHEN m.code IS NULL OR uuId <> 'u7' THEN globalErrorCode ELSE m.new_status END AS status,
  CASE WHEN m.code IS NULL OR uuId <> 'u7' THEN globalErrorCode ELSE m.new_cause END AS cause
FROM cdr LEFT JOIN {CODES} m ON globalErrorCode = m.code""",
)
def _(t):
    code = F.col("globalErrorCode")
    rows = t.cdr.select("event_id", F.col("uuId").alias("transaction_id"), code.alias("status"), code.alias("cause"))
    return E.with_error_text(rows, t.error_codes, "u7").drop("transaction_id")


SENDER_MAP = "(SELECT sender AS s, arg_min(mapping, id) AS v FROM product_mapping GROUP BY sender)"
CLIENT_MAP = "(SELECT client AS s, arg_min(log_mapping, id) AS v FROM product_mapping GROUP BY client)"


@query(
    "mapping_keys", ("staged", "product_mapping"),
    f"""SELECT message_id, coalesce(a.v, sender) AS mapping_key,
  coalesce(b.v, replace(client, ' ', '_')) AS done_key, b.v AS strict_key
FROM staged LEFT JOIN {SENDER_MAP} a ON a.s = sender LEFT JOIN {CLIENT_MAP} b ON b.s = client""",
)
def _(t):
    m = t.product_mapping
    rows = t.staged.select("message_id", "sender", "client")
    rows = E.mapping_key(rows, m, "sender", "mapping")
    rows = E.mapping_key(rows, m, "client", "log_mapping", out="done_key")
    rows = E.mapping_key(rows, m, "client", "log_mapping", out="strict_key", fallback=False)
    return rows.select("message_id", "mapping_key", "done_key", "strict_key")


OLD = "submit_time < '2024-01-16'"
STORED = f"(SELECT DISTINCT source FROM log WHERE {OLD})"


def _stored(t: Inputs) -> DataFrame:
    return t.log.where(OLD)


@query("unseen_sources", ("log",), f"SELECT message_id, source FROM log WHERE source NOT IN {STORED}")
def _(t):
    return X.unseen(t.log, _stored(t), ["source"]).select("message_id", "source")


@query("duplicate_files", ("log",), f"SELECT DISTINCT source FROM log WHERE source IN {STORED}")
def _(t):
    return Q.duplicate_files(t.log, _stored(t))


@query(
    "same_messages", ("cdr",),
    "SELECT event_id, msgId, uuId FROM cdr WHERE msgId IN (SELECT msgId FROM cdr WHERE uuId = 'u7')",
)
def _(t):
    return X.same_messages(t.cdr, "U7").select("event_id", "msgId", "uuId")


@query(
    "cdr_of_day", ("cdr",),
    "SELECT * EXCLUDE (event_id) FROM cdr WHERE cdr_date = DATE '2024-01-12'",
)
def _(t):
    folder = work_folder(t.spark)
    write_cdr(t.cdr.drop("event_id"), folder)
    return read_cdr(t.spark, folder, "2024-01-12").select([c for c in t.cdr.columns if c != "event_id"])


@query(
    "numbers_without_circle", ("staged", "region_all"),
    "SELECT message_id, mobileNo FROM staged WHERE substr(mobileNo, 3, 4) NOT IN (SELECT series FROM region_all)",
)
def _(t):
    return Q.without_circle(t.staged.select("message_id", "mobileNo"), t.region_all)


@query(
    "unmapped_codes", ("cdr", "error_codes"),
    "SELECT globalErrorCode AS code, count(*) AS n FROM cdr WHERE globalErrorCode NOT IN "
    "(SELECT code FROM error_codes) GROUP BY 1",
)
def _(t):
    return Q.unmapped_codes(t.cdr, t.error_codes, "globalErrorCode")


@query(
    "dnd_rows", ("staged",),
    "SELECT mobileNo, cause AS status, submit_time AS date FROM staged WHERE "
    "lower(cause) LIKE '%blocked in preferences with msisdn as pk.%' "
    "OR lower(cause) LIKE '%reserved for preference%' OR lower(cause) LIKE '%ncpr fail%'",
)
def _(t):
    return I.to_dnd(I.route(t.staged, t.product_mapping)).select("mobileNo", "status", "date")


ROUTED = f"""SELECT s.*, CAST(substr(submit_time, 1, 10) AS DATE) AS submit_date, substr(submit_time, 1, 7) AS month,
  coalesce(a.v, sender) AS mapping_key, coalesce(b.v, replace(client, ' ', '_')) AS done_key
FROM staged s LEFT JOIN {SENDER_MAP} a ON a.s = sender LEFT JOIN {CLIENT_MAP} b ON b.s = client"""


@query(
    "message_log_rows", ("staged", "product_mapping"),
    f"SELECT * EXCLUDE (client, base, vendor, channel, done_key) FROM ({ROUTED}) r",
)
def _(t):
    return I.to_log(I.route(t.staged, t.product_mapping))


@query(
    "campaign_table_rows", ("staged", "product_mapping"),
    "SELECT mobileNo, status, submit_time AS date, channel, sender, circle, vendor, source, base, product, "
    f"client, cause, submit_date, month, done_key FROM ({ROUTED}) r",
)
def _(t):
    return I.to_done(I.route(t.staged, t.product_mapping))


@query(
    "promotions_rows", ("staged", "product_mapping"),
    "SELECT mobileNo, circle, vendor, status, product, delivered_time AS date, source, channel, cause, sender, "
    f"client, CAST(substr(delivered_time, 1, 10) AS DATE) AS delivered_date, month FROM ({ROUTED}) r",
)
def _(t):
    return I.to_promo(I.route(t.staged, t.product_mapping))


CAMPAIGN = {
    "source": "recovered", "client": "Client 1", "product": "Product 1", "base": "base1",
    "vendor": "vendor1", "channel": "sms", "sender": "SENDA", "date": "2024-01-12",
}


@query(
    "cdr_staged_rows", ("cdr", "error_codes", "product_mapping"),
    f"""SELECT 'u7' AS transaction_id, msgId AS message_id, mobileNo, senderName AS sender, text, msgType AS type,
  length, cost, CASE WHEN m.code IS NULL THEN globalErrorCode ELSE m.new_status END AS status,
  CASE WHEN m.code IS NULL THEN globalErrorCode ELSE m.new_cause END AS cause, 'UI' AS channel_name,
  strftime(epoch_ms(submitTime), '%Y-%m-%d %H:%M:%S') AS submit_time,
  strftime(epoch_ms(deliveryTime), '%Y-%m-%d %H:%M:%S') AS delivered_time, '' AS ip,
  string_split(additionalData, ',')[:10][-1] AS entity_id, string_split(additionalData, ',')[:11][-1] AS template_id,
  'recovered' AS source, 'Client 1' AS client, 'Product 1' AS product, 'base1' AS base, 'NA' AS circle,
  'vendor1' AS vendor, 'sms' AS channel
FROM cdr LEFT JOIN {CODES} m ON globalErrorCode = m.code
WHERE msgId IN (SELECT msgId FROM cdr WHERE uuId = 'u7')""",
)
def _(t):
    return E.with_error_text(I.cdr_rows(t.cdr, "u7", CAMPAIGN), t.error_codes, "u7")


EARLY = "report_date < DATE '1994-01-01'"


@query(
    "feed_a_load", ("lead_feed_a",),
    f"""SELECT id, report_date, phone, utm_medium, amount FROM
  (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY id) AS rn FROM lead_feed_a WHERE kind = 'lead') x
WHERE rn = 1 AND phone NOT IN (SELECT phone FROM lead_feed_a WHERE kind = 'sale' AND {EARLY})""",
)
def _(t):
    rows = t.lead_feed_a
    leads = by(rows, kind="lead").drop("kind").withColumn("place", F.col("id"))
    stored = by(rows, kind="sale").where(EARLY)
    return first_per_phone(leads, stored, order=["place"]).select("id", "report_date", "phone", "utm_medium", "amount")


@query(
    "feed_append", ("lead_feed_b",),
    "SELECT * FROM lead_feed_b WHERE lead_id NOT IN (SELECT lead_id FROM lead_feed_b WHERE lead_date < DATE '1995-06-01')",
)
def _(t):
    rows = t.lead_feed_b
    return append_feed(rows, rows.where("lead_date < DATE '1995-06-01'"), "lead_id")


NEW_MAPPINGS = """, new_entries AS (SELECT DISTINCT sender, client, product, channel, concat(sender, ' new') AS mapping,
  concat(client, ' new') AS log_mapping FROM staged)"""
IDENTITY = ("sender", "client", "product", "channel")
SAME = " AND ".join(f"m.{c} = n.{c}" for c in IDENTITY)
DIGEST = "md5(concat_ws(chr(31), sender, client, product, channel, mapping, log_mapping))"


def _new_entries(t: Inputs) -> DataFrame:
    # Every combination of all rows, not made distinct: the batch holds many repeats.
    return t.staged.select(
        *IDENTITY, F.concat("sender", F.lit(" new")).alias("mapping"), F.concat("client", F.lit(" new")).alias("log_mapping")
    )


@query(
    "add_mappings", ("staged", "product_mapping"),
    f"""{NEW_MAPPINGS} SELECT CAST((SELECT max(id) FROM product_mapping) + row_number() OVER (ORDER BY {DIGEST}) AS INTEGER) AS id, *
FROM new_entries n WHERE NOT EXISTS (SELECT 1 FROM product_mapping m WHERE {SAME})""",
)
def _(t):
    return M.add_mappings(t.product_mapping, _new_entries(t))[0]


@query(
    "existing_mappings", ("staged", "product_mapping"),
    f"""{NEW_MAPPINGS} SELECT * FROM new_entries n WHERE EXISTS (SELECT 1 FROM product_mapping m WHERE {SAME})""",
)
def _(t):
    return M.add_mappings(t.product_mapping, _new_entries(t))[1].distinct()


# Changes to the mappings of one channel; those of one client lack a field.
@query(
    "update_mapping", ("product_mapping",),
    """SELECT id, sender, client, product, channel,
  CASE WHEN channel = 'sms' AND client <> 'Client 4' THEN concat(mapping, ' x') ELSE mapping END AS mapping, log_mapping
FROM product_mapping""",
)
def _(t):
    m = t.product_mapping
    changes = by(m, channel="sms").withColumn("mapping", F.concat("mapping", F.lit(" x"))).withColumn(
        "rcs_mapping", F.when(F.col("client") == "Client 4", "").otherwise("r")
    )
    return M.update_mapping(m, changes)


@query(
    "mapped_name", ("product_mapping",),
    "SELECT mapping FROM product_mapping WHERE client = 'Client 3' ORDER BY id LIMIT 1",
)
def _(t):
    return E.mapped_name(t.product_mapping, "client", "CLIENT 3", "mapping")


# New: every document. Stored: every document, each second one under another id. Transactional: toxic ones.
TEMPLATE_SQL = """SELECT replace(tempid, '''', '') AS tempid, sender, count, text, type, month FROM (
  SELECT *, 'HSCC' AS type, 'apr25' AS month FROM template_rows
  UNION ALL SELECT * REPLACE (concat(tempid, '_old') AS tempid), 'old', 'mar25' FROM template_rows
    WHERE CAST(replace(tempid, '''', '') AS BIGINT) % 2 = 0) x
WHERE replace(tempid, '''', '') NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"""


def _template_inputs(t: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = t.template_rows
    even = F.pmod(F.replace("tempid", F.lit("'"), F.lit("")).cast("bigint"), F.lit(2)) == 0
    stored = rows.withColumn("tempid", F.when(even, F.concat("tempid", F.lit("_old"))).otherwise(F.col("tempid")))
    stored = stored.withColumn("type", F.lit("old")).withColumn("month", F.lit("mar25")).select(TEMPLATES.names)
    toxic = t.labels.where("toxic = 1").select(F.concat(F.lit("'"), F.col("doc_id").cast("string")).alias("tempid"))
    return stored, rows, toxic


@query("refresh_templates", ("template_rows",), TEMPLATE_SQL)
def _(t):
    stored, new, toxic = _template_inputs(t)
    return refresh_templates(stored, new, toxic, "HSCC", "apr25\n")


# The same through files and the stored table; a line end read from a file is a plain one.
@query(
    "load_templates", ("template_rows",),
    TEMPLATE_SQL.replace("text, type", "CASE WHEN type = 'HSCC' THEN replace(text, concat(chr(13), chr(10)), chr(10)) ELSE text END AS text, type"),
)
def _(t):
    folder = work_folder(t.spark)
    stored, new, toxic = _template_inputs(t)
    replace_table(stored, f"{folder}/templates")
    cells = new.select(F.col("tempid").alias("TemplateId"), F.col("sender").alias("Sender"), F.col("count").alias("Count"), F.col("text").alias("Text"))
    cells.write.options(**CSV).csv(f"{folder}/in")
    load_templates(t.spark, f"{folder}/in", f"{folder}/templates", toxic, "HSCC", "apr25")
    return read_current(t.spark, f"{folder}/templates", TEMPLATES)


ENTRIES = ", ".join(c for c in MAPPING.names if c != "id")
# Ids start anew in a table that was empty, in the order of the entries' digests.
SAVED = f"""SELECT CAST(row_number() OVER (ORDER BY {DIGEST}) AS INTEGER) AS id, {ENTRIES} FROM product_mapping"""


def _saved(t: Inputs) -> str:
    """The mapping saved twice into an empty table; the second time nothing is new."""
    path = f"{work_folder(t.spark)}/mapping"
    for _ in range(2):
        save_mappings(t.product_mapping.drop("id"), path)
    return path


@query("save_mappings", ("product_mapping",), SAVED)
def _(t):
    return read_current(t.spark, _saved(t), MAPPING)


@query(
    "change_mappings", ("product_mapping",),
    f"SELECT * REPLACE (CASE WHEN channel = 'sms' THEN concat(mapping, ' x') ELSE mapping END AS mapping) FROM ({SAVED}) s",
)
def _(t):
    path = _saved(t)
    changes = by(read_current(t.spark, path, MAPPING), channel="sms")
    change_mappings(changes.withColumn("mapping", F.concat("mapping", F.lit(" x"))).withColumn("rcs_mapping", F.lit("r")), path)
    return read_current(t.spark, path, MAPPING)


@query("files_of_month", ("files",), "SELECT filename, filepath FROM files WHERE filename ILIKE '%Apr%'")
def _(t):
    return files_for_month(t.files, "Apr").select("filename", "filepath")


@query(
    "files_not_in_ledger", ("files",),
    "SELECT filename, filepath FROM files WHERE newest >= DATE '1997-01-01'",
)
def _(t):
    return ledger_filter(t.files, t.files.where("newest < DATE '1997-01-01'")).select("filename", "filepath")


@query(
    "files_by_month_word", ("files",),
    "SELECT CASE WHEN filename = 'Leads.xlsx' THEN 'Jun' ELSE regexp_extract(filename, '[A-Z][a-z][a-z]', 0) END AS month, "
    "count(*) AS n FROM (SELECT replace(filename, 'Leads ', '') AS filename FROM files) f GROUP BY 1",
)
def _(t):
    return t.files.groupBy(month_in_name(F.col("filename"), "Jun").alias("month")).agg(F.count(F.lit(1)).alias("n"))
