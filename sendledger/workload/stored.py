"""Reports over stored tables, found by name through the mapping, and whole feed loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sendledger.operators import reports as R
from sendledger.operators.feed_a import feed_a_counts
from sendledger.plans.feeds import LOADED, load_feed, read_stored_feed
from sendledger.plans.ingest import DONE, LOG, Store, ingest
from sendledger.plans.lookup import client_base, stored_rows
from sendledger.schemas import FEEDS
from sendledger.session import work_folder
from sendledger.workload.campaigns import DAY, END, START
from sendledger.workload.loads import CLIENT_MAP, REGION, SENDER_MAP
from sendledger.workload.registry import CSV, Inputs, ORACLES, query

CLIENT = "client 3"  # one that the mapping knows
USES = ("staged", "region_all", "product_mapping")
_STORES: dict[tuple[str, str], Store] = {}


def _store(t: Inputs) -> Store:
    """The sample rows loaded into stored tables, once in a session."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _STORES:
        store = Store(t.spark, work_folder(t.spark))
        ingest(t.staged, store, t.product_mapping, t.region_all)
        _STORES[key] = store
    return _STORES[key]


def _log(t: Inputs, start=START, end=END) -> DataFrame:
    return stored_rows(_store(t), LOG, t.product_mapping, "senda", start, end)


def _done(t: Inputs, start, end) -> DataFrame:
    return stored_rows(_store(t), DONE, t.product_mapping, CLIENT, start, end)


ROWS = f"""(SELECT s.* REPLACE (CASE WHEN r.series IS NOT NULL THEN r.c ELSE circle END AS circle), submit_time AS date,
  substr(submit_time, 1, 7) AS month, coalesce(a.v, replace(sender, ' ', '_')) AS mapping_key,
  coalesce(b.v, replace(client, ' ', '_')) AS done_key
FROM staged s LEFT JOIN {REGION} r ON substr(mobileNo, 3, 4) = r.series LEFT JOIN {SENDER_MAP} a ON a.s = sender
LEFT JOIN {CLIENT_MAP} b ON b.s = client)"""
OF_SENDER = f"(SELECT * FROM {ROWS} x WHERE mapping_key = (SELECT v FROM {SENDER_MAP} m WHERE s = 'SENDA'))"
OF_CLIENT = f"(SELECT * FROM {ROWS} x WHERE done_key = (SELECT v FROM {CLIENT_MAP} m WHERE s = 'Client 3'))"


def _twin(name: str) -> str:
    """The SQL of a report over all rows, taken to the stored rows of one sender or client."""
    sql = _body(ORACLES[name])
    if "FROM done" in sql:  # the campaign table: another client, whose rows lie in January
        sql = sql.replace("'client 2'", f"'{CLIENT}'").replace("'2024-05-", "'2024-01-")
    return sql.replace("FROM log", f"FROM {OF_SENDER} log").replace("FROM done", f"FROM {OF_CLIENT} done")


def _body(sql: str) -> str:
    """A registered query without the clause that defines its fixtures."""
    depth, at = 0, len("WITH ")
    while True:
        at = sql.index("(", at)
        while True:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
            if not depth:
                break
        if sql[at] != ",":
            return sql[at:].lstrip()


def _months(sql: str, start: str, end: str) -> str:
    """Reports without a range of their own see the months that were asked for."""
    return sql.replace("WHERE mapping_key", f"WHERE month BETWEEN '{start[:7]}' AND '{end[:7]}' AND mapping_key")


def stored(name: str, sql: str | None = None):
    return query(f"stored_{name}", USES, sql or _months(_twin(name), START, END))


@stored("campaign_summary")
def _(t):
    return R.campaign_summary(_log(t), "senda", START, END)


@stored("source_group_totals")
def _(t):
    return R.group_totals(_log(t), "senda", START, END)


@stored("undelivered_causes")
def _(t):
    return R.undelivered_causes(_log(t))


@stored("cause_ranking")
def _(t):
    return R.cause_ranking(_log(t), START, END)


@stored("message_texts")
def _(t):
    return R.message_texts(_log(t), "2024-03")


@stored("day_totals", _months(_twin("day_totals"), DAY, DAY))
def _(t):
    return R.day_totals(_log(t, DAY, DAY), DAY)


@stored("delivered_by_circle", _months(_twin("delivered_by_circle"), DAY, DAY))
def _(t):
    return R.delivered_by_circle(_log(t, DAY, DAY), DAY)


@stored("monthly_trend")
def _(t):
    return R.monthly_trend(_log(t))


@stored("daily_trend")
def _(t):
    return R.daily_trend(_log(t))


FIRST, LAST = "2024-01-03", "2024-01-28"


@stored("base_check", _twin("base_check"))
def _(t):
    return client_base(_store(t), t.product_mapping, CLIENT, FIRST, LAST)


@stored("day_circle_status", _twin("day_circle_status"))
def _(t):
    return R.day_circle_status(_done(t, FIRST, LAST), CLIENT, FIRST, LAST)


@stored("campaign_combinations", _twin("campaign_combinations"))
def _(t):
    return R.campaign_combinations(_done(t, FIRST, LAST), CLIENT, FIRST, LAST)


def _sheet(rows: DataFrame, folder: str, feed: str, kind: str, filled: dict[str, F.Column]) -> None:
    names = FEEDS[(feed, kind)]
    cells = rows.select([filled.get(n, F.lit("")).alias(n) for n in names])
    cells.write.options(**CSV).csv(f"{folder}/{kind}.csv")


def _feed_a_months(t: Inputs) -> str:
    """Feed A loaded in two months: rows of odd orders, then those of even ones; a phone counts once a month."""
    root, rows = work_folder(t.spark), t.lead_feed_a
    for i, month in enumerate(("2025-05", "2025-06")):
        folder = f"{root}/in{i}"
        for kind, side in (("leads", "lead"), ("sales", "sale")):
            part = rows.where((F.col("kind") == side) & (F.pmod(F.floor(F.col("id") / 8), F.lit(2)) == i))
            filled = {"report_date": F.date_format("report_date", "M/d/yyyy"), "phone": F.col("phone"),
                      "utm_medium": F.col("utm_medium"), "amount": F.col("amount")}
            _sheet(part, folder, "A", kind, {k: v for k, v in filled.items() if k in FEEDS[("A", kind)]})
        load_feed(t.spark, folder, f"Leads {i}.xlsx", "A", root, month)
    return root


# Which row of a phone is first follows the files, so the day counts are compared over phones alone.
@query(
    "feed_a_loaded_counts", ("lead_feed_a",),
    """SELECT kind, (id // 8) % 2 AS part, count(DISTINCT phone) AS stored, count(DISTINCT phone) AS ids
FROM lead_feed_a GROUP BY 1, 2""",
)
def _(t):
    root = _feed_a_months(t)
    sides = []
    for kind, side in (("leads", "lead"), ("sales", "sale")):
        rows = read_stored_feed(t.spark, root, "A", kind)
        month = F.when(F.col("load_month") == "2025-05", 0).otherwise(1).cast("bigint")
        # An id of one month that came again in the other would be counted once here.
        once = rows.groupBy("id").agg(F.min(month).alias("part"), F.count(F.lit(1)).alias("n"))
        sides.append(once.groupBy("part").agg(F.sum("n").alias("stored"), F.count(F.lit(1)).alias("ids")).withColumn("kind", F.lit(side)))
    return sides[0].unionByName(sides[1]).select("kind", "part", "stored", "ids")


@query(
    "feed_a_loaded_totals", ("lead_feed_a",),
    """SELECT CAST(sum(CASE WHEN kind = 'lead' THEN n END) AS BIGINT) AS leads,
  CAST(sum(CASE WHEN kind = 'sale' THEN n END) AS BIGINT) AS sales
FROM (SELECT kind, (id // 8) % 2 AS part, count(DISTINCT phone) AS n FROM lead_feed_a WHERE utm_medium IS NOT NULL
  AND phone NOT IN (SELECT phone FROM lead_feed_a WHERE utm_medium IS NULL) GROUP BY 1, 2) x""",
)
def _(t):
    root = _feed_a_months(t)
    unkeyed = t.lead_feed_a.where("utm_medium IS NULL").select("phone").distinct()
    sides = [read_stored_feed(t.spark, root, "A", k).join(unkeyed, "phone", "left_anti") for k in ("leads", "sales")]
    counted = feed_a_counts(*sides)
    return counted.agg(F.sum("lead_count").alias("leads"), F.sum("sale_count").alias("sales"))


@query(
    "feed_b_replaced", ("lead_feed_b",),
    """SELECT lead_id, lead_date, camp_type, coalesce(lead_category, '') AS lead_category, lead_status, '2025-05' AS load_month
FROM lead_feed_b WHERE CAST(lead_id AS BIGINT) % 2 = 0 UNION ALL
SELECT lead_id, lead_date, camp_type, coalesce(lead_category, ''), lead_status, '2025-06' FROM lead_feed_b""",
)
def _(t):
    """May is loaded from all rows, then replaced by half of them; June stays."""
    root, rows = work_folder(t.spark), t.lead_feed_b
    even = rows.where(F.pmod(F.col("lead_id").cast("bigint"), F.lit(2)) == 0)
    names = ["lead_id", "camp_type", "lead_category", "lead_status"]
    for i, (month, part) in enumerate((("2025-05", rows), ("2025-06", rows), ("2025-05", even))):
        filled = {"lead_date": F.date_format("lead_date", "dd-MMM-yy"), **{n: F.col(n) for n in names}}
        _sheet(part, f"{root}/in{i}", "B", "leads", filled)
        load_feed(t.spark, f"{root}/in{i}", f"Leads {i}.xlsx", "B", root, month)
    return read_stored_feed(t.spark, root, "B", "leads").select("lead_id", "lead_date", "camp_type", "lead_category", "lead_status", "load_month")


@query(
    "feed_c_loaded", ("raw_days",),
    """SELECT k.kind, o_orderkey AS key, coded AS utm_campaign, CASE WHEN o_orderkey % 2 = 0 THEN 'BT' ELSE 'Fresh' END AS bt
FROM raw_days, (VALUES ('leads'), ('login'), ('approval'), ('disbursal')) k(kind)""",
)
def _(t):
    """Half of the rows, then all of them: the second load adds the other half."""
    root, rows = work_folder(t.spark), t.raw_days
    kind_of_loan = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "BT").otherwise("Fresh")
    for i, part in enumerate((rows.where(F.pmod("o_orderkey", F.lit(3)) == 0), rows)):
        for kind in LOADED["C"]:
            key, loan = ("offer_id", "bt_f") if kind == "leads" else ("customer_id", "bt")
            _sheet(part, f"{root}/in{i}", "C", kind, {key: F.col("o_orderkey"), "utm_campaign": F.col("coded"), loan: kind_of_loan})
        load_feed(t.spark, f"{root}/in{i}", f"Leads {i}.xlsx", "C", root, "2025-05")
    sides = []
    for kind in LOADED["C"]:
        key, loan = ("offer_id", "bt_f") if kind == "leads" else ("customer_id", "bt")
        stored_sheet = read_stored_feed(t.spark, root, "C", kind, "2025-05")
        sides.append(stored_sheet.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("key"), "utm_campaign", F.col(loan).alias("bt")))
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
