"""Campaign-shaped inputs derived from the sample tables.

Each block is SQL that Spark and DuckDB both accept unchanged, so an operator and
its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TS = "CAST(ts AS VARCHAR(40))"
_DAY = "CAST(o_orderdate AS VARCHAR(40))"
_MONTH_WORD = (
    f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(substr({_DAY}, 6, 2) AS INT) * 3 - 2, 3)"
)
_DAY_NUMBER = f"CAST(CAST(substr({_DAY}, 9, 2) AS INT) AS VARCHAR(2))"
_US_MINUTE = (
    f"concat(CAST(CAST(substr({_TS}, 6, 2) AS INT) AS VARCHAR(2)), '/', "
    f"CAST(CAST(substr({_TS}, 9, 2) AS INT) AS VARCHAR(2)), '/', substr({_TS}, 1, 4), ' ', "
    f"CAST(CAST(substr({_TS}, 12, 2) AS INT) AS VARCHAR(2)), ':', substr({_TS}, 15, 2))"
)
_SHIFTED = f"concat('2024-0', CAST(1 + 2 * (user_id % 3) AS VARCHAR(1)), substr({_TS}, 8, 12))"

# name -> (tables or other fixtures it reads, SQL)
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "region_all": (
        ("nation",),
        "SELECT CAST(9000 + n_nationkey * 3 AS VARCHAR(4)) AS series, n_name AS circle FROM nation",
    ),
    "staged": (
        ("events",),
        f"""SELECT
  CAST(event_id % 97 AS VARCHAR(20)) AS transaction_id,
  CAST(event_id AS VARCHAR(20)) AS message_id,
  concat('91', CAST(9000000000 + user_id * 1000003 + event_id % 7 AS VARCHAR(12))) AS mobileNo,
  CASE user_id % 3 WHEN 0 THEN 'SENDA' WHEN 1 THEN 'SENDB' ELSE 'SENDC' END AS sender,
  concat('offer ', CAST(event_id % 11 AS VARCHAR(5))) AS text,
  'TEXT' AS type,
  CAST(length(props) AS VARCHAR(5)) AS length,
  '1' AS cost,
  CASE event_type WHEN 'purchase' THEN 'Delivered' WHEN 'signup' THEN 'DELIVERED'
    WHEN 'view' THEN '000' WHEN 'click' THEN 'FAILED'
    ELSE CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'NOTSENT' END END AS status,
  CASE event_type WHEN 'purchase' THEN 'Delivered' WHEN 'signup' THEN 'Delivered'
    WHEN 'view' THEN '000'
    WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'NCPR Fail'
      WHEN 1 THEN 'Absent Subscriber' ELSE 'reserved for preference 2' END
    ELSE CASE WHEN event_id % 4 = 0 THEN NULL
      ELSE 'blocked in preferences with msisdn as pk.' END END AS cause,
  'bulk' AS channel_name,
  {_SHIFTED} AS submit_time,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE {_SHIFTED} END AS delivered_time,
  '10.0.0.1' AS ip,
  concat('E', CAST(user_id AS VARCHAR(10))) AS entity_id,
  concat('T', CAST(event_id % 50 AS VARCHAR(10))) AS template_id,
  concat(CASE user_id % 5 WHEN 0 THEN 'CM_LB' WHEN 1 THEN 'CM_LH' WHEN 2 THEN 'CM_MX'
    WHEN 3 THEN 'HN_AB' ELSE 'ZZ_QQ' END, '_', substr({_TS}, 9, 2),
    '0', CAST(1 + 2 * (user_id % 3) AS VARCHAR(1)), '.', CAST(event_id % 2 AS VARCHAR(2))) AS source,
  concat('Client ', CAST(user_id % 6 AS VARCHAR(2))) AS client,
  concat('Product ', CAST(user_id % 5 AS VARCHAR(2))) AS product,
  concat('base', CAST(user_id % 4 AS VARCHAR(2))) AS base,
  'Unknown' AS circle,
  concat('vendor', CAST(event_id % 3 AS VARCHAR(2))) AS vendor,
  CASE WHEN user_id % 2 = 0 THEN 'sms' ELSE 'rcs' END AS channel
FROM events""",
    ),
    "log": (
        ("staged",),
        "SELECT *, substr(submit_time, 1, 7) AS month FROM staged",
    ),
    "done": (
        ("log",),
        "SELECT mobileNo, status, submit_time AS date, channel, sender, circle, vendor, source, "
        "base, product, client, cause, month FROM log",
    ),
    "promo": (
        ("log",),
        "SELECT mobileNo, circle, vendor, status, product, delivered_time AS date, source, "
        "channel, cause, sender, client, month FROM log",
    ),
    "product_mapping": (
        ("staged",),
        """SELECT CAST(min(CAST(message_id AS INT)) AS INT) AS id, sender, client, product, channel,
  concat('m', CAST(min(CAST(message_id AS INT)) AS VARCHAR(10))) AS mapping,
  concat('d', CAST(min(CAST(message_id AS INT)) AS VARCHAR(10))) AS log_mapping
FROM staged WHERE sender <> 'SENDC' AND client <> 'Client 5'
GROUP BY sender, client, product, channel""",
    ),
    "error_codes": (
        ("events",),
        """SELECT DISTINCT CASE event_type WHEN 'purchase' THEN '000' WHEN 'click' THEN '101'
    ELSE '202' END AS code,
  CASE event_type WHEN 'purchase' THEN 'Delivered' WHEN 'click' THEN 'Failed' ELSE 'Rejected' END AS status,
  concat('cause of ', event_type) AS cause
FROM events""",
    ),
    "cdr": (
        ("events",),
        f"""SELECT concat('u', CAST(user_id AS VARCHAR(10))) AS uuId,
  concat('g', CAST(event_id % 997 AS VARCHAR(10))) AS msgId,
  concat('91', CAST(9000000000 + user_id * 1000003 AS VARCHAR(12))) AS mobileNo,
  CASE user_id % 3 WHEN 0 THEN 'SENDA' WHEN 1 THEN 'SENDB' ELSE 'SENDC' END AS senderName,
  concat('offer ', CAST(event_id % 11 AS VARCHAR(5))) AS text,
  'TEXT' AS msgType, CAST(length(props) AS VARCHAR(5)) AS length, '1' AS cost,
  CASE event_id % 4 WHEN 0 THEN '000' WHEN 1 THEN '101' WHEN 2 THEN '202' ELSE '999' END AS globalErrorCode,
  1704067200000 + event_id * 260000 AS submitTime,
  1704067200000 + event_id * 260000 + 4321 AS deliveryTime,
  CASE WHEN event_id % 3 = 0 THEN 'a,b,c' ELSE concat('1,2,3,4,5,6,7,8,9,ENT',
    CAST(user_id AS VARCHAR(10)), ',TPL', CAST(event_id % 50 AS VARCHAR(10)), ',z') END AS additionalData,
  CAST(substr({_TS}, 1, 10) AS DATE) AS cdr_date, event_id
FROM events""",
    ),
    # Texts as they stand in the input files, before cleaning.
    "raw_cells": (
        ("events",),
        f"""SELECT event_id,
  CASE event_id % 7 WHEN 0 THEN {_US_MINUTE} WHEN 1 THEN '' WHEN 2 THEN 'In Process'
    WHEN 3 THEN concat('"', {_US_MINUTE}, '"') WHEN 4 THEN NULL WHEN 5 THEN '  '
    ELSE substr({_TS}, 1, 19) END AS raw_ts,
  CASE event_id % 4 WHEN 0 THEN concat('9.19', CAST(10000000 + user_id AS VARCHAR(10)), 'E+11')
    WHEN 1 THEN '' WHEN 2 THEN concat('91', CAST(9000000000 + user_id AS VARCHAR(12)))
    ELSE NULL END AS raw_mobile,
  CASE event_id % 3 WHEN 0 THEN concat('''', CAST(event_id AS VARCHAR(12)), '''')
    WHEN 1 THEN concat('  ', CAST(event_id AS VARCHAR(12)), '  ') ELSE '''''' END AS raw_txn,
  concat(' `', CAST(event_id AS VARCHAR(12)), '`') AS raw_tag,
  CASE event_id % 4 WHEN 0 THEN concat(CAST(event_id AS VARCHAR(12)), 'abc') WHEN 1 THEN 'n/a'
    WHEN 2 THEN '' ELSE concat(' -', CAST(event_id AS VARCHAR(12)), '.75x') END AS raw_number,
  CASE event_id % 4 WHEN 0 THEN concat(' 91', CAST(6000000000 + event_id AS VARCHAR(12)), ' ')
    WHEN 1 THEN CAST(9000000000 + event_id AS VARCHAR(12))
    WHEN 2 THEN CAST(5000000000 + event_id AS VARCHAR(12)) ELSE '98x' END AS raw_entry,
  concat('file:/landing/a%20b/', CASE user_id % 3 WHEN 0 THEN 'CM_LB%20' ELSE 'HN+' END,
    CAST(event_id AS VARCHAR(12)),
    CASE event_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.v1.txt' ELSE '' END) AS path,
  concat('Club  ', CAST(user_id AS VARCHAR(10)), ' of-Mumbai') AS raw_name
FROM events""",
    ),
    "raw_days": (
        ("orders",),
        f"""SELECT o_orderkey,
  CASE o_orderkey % 4
    WHEN 0 THEN concat(CAST(CAST(substr({_DAY}, 6, 2) AS INT) AS VARCHAR(2)), '/', {_DAY_NUMBER}, '/', substr({_DAY}, 3, 2))
    WHEN 1 THEN concat(CAST(CAST(substr({_DAY}, 6, 2) AS INT) AS VARCHAR(2)), '/', {_DAY_NUMBER}, '/', substr({_DAY}, 1, 4))
    WHEN 2 THEN substr({_DAY}, 1, 10) ELSE 'no day' END AS sheet_cell,
  concat(substr({_DAY}, 9, 2), '-', {_MONTH_WORD}, '-', substr({_DAY}, 3, 2)) AS named_day,
  concat(substr({_DAY}, 1, 10), ' 11:22:33') AS second_text,
  concat(CAST(CAST(substr({_DAY}, 6, 2) AS INT) AS VARCHAR(2)), '/', {_DAY_NUMBER}, '/', substr({_DAY}, 1, 4)) AS us_day,
  CASE o_orderkey % 3
    WHEN 0 THEN concat('Leads ', {_DAY_NUMBER}, '-', {_MONTH_WORD}, '''', substr({_DAY}, 3, 2), '.xlsx')
    WHEN 1 THEN concat('Leads ', {_DAY_NUMBER}, 'th ', {_MONTH_WORD}, '.xlsx')
    ELSE 'Leads.xlsx' END AS filename,
  concat('CAMP_SM_', substr({_DAY}, 9, 2), substr({_DAY}, 6, 2)) AS coded,
  CAST(o_orderdate AS DATE) AS day
FROM orders""",
    ),
    "files": (
        ("raw_days",),
        "SELECT filename, concat('/files/', filename) AS filepath, max(day) AS newest "
        "FROM raw_days GROUP BY filename",
    ),
    "lead_feed_a": (
        ("orders",),
        f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'sale' ELSE 'lead' END AS kind,
  CAST(o_orderdate AS DATE) AS report_date,
  CAST(o_custkey AS VARCHAR(20)) AS phone,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat(
    CASE WHEN o_orderkey % 3 = 0 THEN 'SM_Acko_car_' ELSE 'RC_other_' END,
    substr({_DAY}, 9, 2), '_', substr({_DAY}, 6, 2), '_', substr({_DAY}, 1, 4)) END AS utm_medium,
  CAST(o_totalprice AS DECIMAL(10,2)) AS amount
FROM orders""",
    ),
    "lead_feed_b": (
        ("orders", "customer"),
        """SELECT CAST(o_orderkey AS VARCHAR(20)) AS lead_id,
  CAST(o_orderdate AS DATE) AS lead_date,
  concat('X-', c_mktsegment, '-', CAST(o_custkey % 7 AS VARCHAR(3))) AS reffer_id_source,
  CASE o_orderkey % 4 WHEN 0 THEN 'Other Cities' WHEN 1 THEN 'Metro'
    WHEN 2 THEN ' Metro ' ELSE 'NE Other Cities A' END AS camp_type,
  CASE o_orderstatus WHEN 'F' THEN 'QL' WHEN 'O' THEN 'NQL' ELSE NULL END AS lead_category,
  CASE WHEN o_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS tg,
  CASE o_orderkey % 6 WHEN 0 THEN 'Appointment fixed' WHEN 1 THEN 'callback'
    WHEN 2 THEN 'Follow Up' WHEN 3 THEN 'busy' WHEN 4 THEN 'ringing no response'
    ELSE 'closed' END AS lead_status,
  CASE WHEN o_orderkey % 17 = 0 THEN 'n/a'
    ELSE CAST(o_orderkey % 5 AS VARCHAR(2)) END AS no_of_call_attempts
FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "funnel_base": (
        ("orders",),
        f"""SELECT o_orderkey AS row_id, o_orderstatus AS st, o_totalprice AS amt,
  concat('CAMP_', CASE o_orderkey % 5 WHEN 0 THEN 'RC_J_' WHEN 1 THEN 'RC_'
    WHEN 2 THEN 'SM_' WHEN 3 THEN 'EM_' ELSE 'sm_' END,
    substr({_DAY}, 9, 2), substr({_DAY}, 6, 2)) AS utm_campaign,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'BT'
    WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'Fresh' END AS bt
FROM orders""",
    ),
    "template_rows": (
        ("documents",),
        """SELECT concat('''', CAST(doc_id AS VARCHAR(18))) AS tempid, source AS sender,
  CAST(n_chars AS VARCHAR(20)) AS count, text, lang
FROM documents""",
    ),
}


def with_blocks(*names: str) -> str:
    """The ``WITH`` clause that defines the named fixtures and all they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dependency in FIXTURES[name][0]:
            if dependency in FIXTURES:
                add(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n][1]})" for n in ordered) + "\n"


def _tables(name: str) -> set[str]:
    if name not in FIXTURES:
        return {name}
    return set().union(*[_tables(d) for d in FIXTURES[name][0]])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table or a fixture as a DataFrame."""
    for table in _tables(name):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    if name not in FIXTURES:
        return spark.table(name)
    return spark.sql(with_blocks(name) + f"SELECT * FROM {name}")
