"""Lead feed A: leads and sales that meet on the day in their campaign medium."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from sendledger.functions.dates import DAY_KEY, day_key, try_date

LEAD_ONLY = ["quote_load", "gmb_definition"]
SALE_ONLY = ["gwp", "amount"]


def _medium_day(day: date | str) -> str:
    d = day if isinstance(day, date) else date.fromisoformat(day)
    return d.strftime("%d_%m_%Y")


def feed_a_counts(leads: DataFrame, sales: DataFrame, mediums: bool = False) -> DataFrame:
    """Distinct leads and distinct sales by day key, by date; on request with the list of mediums.

    Each lead and sale is brought to one row per day first: a join of the raw rows would
    pair every lead of a day with every sale of that day. ``feed_a_mediums`` gives the mediums
    as rows; the list is for days whose mediums are few.
    """
    key = day_key(F.col("utm_medium")).alias("extracted_date")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(key, F.lit(name).alias("side"), "id", "utm_medium")

    both = side(leads, "lead").unionByName(side(sales, "sale"))
    seen = [F.collect_set("utm_medium").alias("mediums")] if mediums else []
    each = both.groupBy("extracted_date", "side", "id")
    each = each.agg(*seen) if mediums else each.agg(F.lit(None).alias("nothing")).drop("nothing")

    def counted(name: str) -> Column:
        n = F.count(F.when(F.col("side") == name, F.col("id")))
        # Rows without a medium form a group of their own that matches no lead or sale.
        return F.when(F.col("extracted_date").isNull(), 0).otherwise(n).cast("bigint").alias(f"{name}_count")

    listed = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("mediums")))), ",") if mediums else None
    totals = [F.nullif(listed, F.lit("")).alias("all_mediums")] if mediums else []
    return (
        each.groupBy("extracted_date")
        .agg(*totals, counted("lead"), counted("sale"))
        .orderBy(try_date(F.col("extracted_date"), DAY_KEY), "extracted_date")
    )


def feed_a_mediums(leads: DataFrame, sales: DataFrame) -> DataFrame:
    """The mediums of ``feed_a_counts`` as rows, for days with very many of them."""
    both = leads.select("utm_medium").unionByName(sales.select("utm_medium"))
    return both.distinct().select(day_key(F.col("utm_medium")).alias("extracted_date"), "utm_medium")


def leads_with_sales(leads: DataFrame, sales: DataFrame) -> DataFrame:
    """Each lead with the number and amount of the sales sharing its day key.

    Sales are summed per day before the join, so every lead stays one row.
    """
    per_day = sales.groupBy(day_key(F.col("utm_medium")).alias("day_key")).agg(
        F.count(F.lit(1)).alias("day_sales"), F.sum("amount").alias("day_amount")
    )
    return leads.withColumn("day_key", day_key(F.col("utm_medium"))).join(
        per_day, "day_key", "left"
    ).withColumn("day_sales", F.coalesce("day_sales", F.lit(0).cast("bigint")))


def leads_of_day(leads: DataFrame, day) -> DataFrame:
    return leads.where(F.col("utm_medium").like(f"%{_medium_day(day)}%"))


def self_dated() -> Column:
    """A sale whose medium holds its own report date."""
    return F.expr("utm_medium LIKE concat('%', date_format(report_date, 'dd_MM_yyyy'), '%')")


def feed_a_detail(
    leads: DataFrame, sales: DataFrame, day, sale_medium: str, parity: bool = False
) -> DataFrame:
    """All leads of a day and the sales of a medium (a LIKE pattern) beside them, one row each.

    ``side`` tells leads from sales. By default the sales are those of the same
    day; ``parity`` takes the sales of any day whose medium holds their own
    report date. Pairs of a lead and a sale are not formed: every lead would
    meet every sale, which says nothing the two lists do not say.
    """
    sale_rows = sales.where(F.col("utm_medium").ilike(sale_medium))
    if parity:
        sale_rows = sale_rows.where(self_dated())
    else:
        sale_rows = sale_rows.where(day_key(F.col("utm_medium")) == _medium_day(day))
    lead_rows = leads_of_day(leads, day)
    return (
        lead_rows.withColumn("side", F.lit("lead"))
        .unionByName(sale_rows.withColumn("side", F.lit("sale")), allowMissingColumns=True)
        .select("side", *[c for c in [*leads.columns, *[x for x in sales.columns if x not in leads.columns]]])
    )


def feed_a_totals(leads: DataFrame, sales: DataFrame, day) -> DataFrame:
    """One row: all leads and all sales whose medium holds the day."""
    zero = F.lit(0).cast("bigint")
    n = F.count(F.lit(1))
    lead_side = leads_of_day(leads, day).agg(n.alias("total_leads"), zero.alias("total_sales"))
    sale_side = leads_of_day(sales, day).agg(zero.alias("total_leads"), n.alias("total_sales"))
    return lead_side.unionByName(sale_side).agg(
        F.sum("total_leads").alias("total_leads"), F.sum("total_sales").alias("total_sales")
    )
