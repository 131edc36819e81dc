"""Campaign reports over the message log, campaign table and promotions log.

Each function takes the rows already narrowed by ``by`` and ``read_months`` and
returns a lazy DataFrame. All group with partial aggregation, so a hot source
leaves each task as one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sendledger.functions.dates import day_of, minute_of
from sendledger.functions.predicates import (
    PRODUCT_DEFAULT, PRODUCT_RULES, any_like, by, label, on_days,
)
from sendledger.functions.text import head_parts, one_of, same_text

# FIXED VALUES: status and cause texts the counters look for.
DELIVERED = ["Delivered", "000", "0"]
NOT_SENT = "NCPR Fail"
ROW_BYTES = 1024


def tally(condition: Column) -> Column:
    """How many rows meet a condition; NULL over no rows."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def counters(suffix: str = "_count", prefix: str = "") -> list[Column]:
    """Submitted, delivered, not sent and failed. A NULL status or cause counts nowhere."""
    status, cause = F.col("status"), F.col("cause")
    measures = {
        "submitted": F.count(status),
        "delivered": tally(one_of(status, DELIVERED)),
        "notsent": tally(same_text(cause, NOT_SENT)),
        "failed": tally(~one_of(cause, [*DELIVERED, NOT_SENT])),
    }
    return [c.alias(f"{prefix}{name}{suffix}") for name, c in measures.items()]


def totals() -> list[Column]:
    return counters(suffix="", prefix="total_")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """The four counters of each sender, source or other key (A0)."""
    return df.groupBy(*keys).agg(*counters())


def _day(df: DataFrame, typed: str, text: str) -> Column:
    """The typed day stored at load, else the day read from the text."""
    return F.col(typed) if typed in df.columns else day_of(F.col(text))


def submit_day(df: DataFrame) -> Column:
    return _day(df, "submit_date", "submit_time")


def promo_day(df: DataFrame) -> Column:
    return _day(df, "delivered_date", "date")


def campaign_summary(
    log: DataFrame, sender: str, start=None, end=None, collapse: bool = False
) -> DataFrame:
    """Counters by source, circle, minute and day of one sender.

    Groups form on the full source name, so a name cut at its first dot may
    stand in several rows; ``collapse`` groups by the cut name.
    """
    rows = on_days(by(log, sender=sender), submit_day(log), start, end)
    cut = head_parts(F.col("source"), ".", 1)
    keys = ["raw_source", "circle", "date", "submitted_date"]
    counted = rows.groupBy(
        (cut if collapse else F.col("source")).alias("raw_source"),
        "circle",
        minute_of(F.col("submit_time")).alias("date"),
        submit_day(rows).alias("submitted_date"),
        "sender",
    ).agg(*counters())
    # Spellings of the sender meet here: a minimum of text next to the row
    # counts would make Spark sort all rows instead of hashing them.
    grouped = counted.groupBy(*keys).agg(
        F.min("sender").alias("product_name"),
        *[F.sum(c).alias(c) for c in counted.columns if c.endswith("_count")],
    )
    return grouped.orderBy("raw_source", "circle", "date").select(
        label(F.col("raw_source"), PRODUCT_RULES, PRODUCT_DEFAULT).alias("product_key"),
        "circle",
        head_parts(F.col("raw_source"), ".", 1).alias("source"),
        "date", "submitted_date", "product_name",
        "submitted_count", "delivered_count", "notsent_count", "failed_count",
    )


def group_totals(log: DataFrame, sender: str, start, end) -> DataFrame:
    """Counters by the first two parts of the source name."""
    rows = on_days(by(log, sender=sender), submit_day(log), start, end)
    return rows.groupBy(head_parts(F.col("source"), "_", 2).alias("source_group")).agg(*totals())


def undelivered_causes(log: DataFrame) -> DataFrame:
    """Rows per source and cause that were not delivered."""
    return (
        log.where(~same_text(F.col("status"), "delivered"))
        .groupBy(F.col("source").alias("raw_source"), "cause")
        .agg(F.count(F.lit(1)).alias("total_failed"))
        .select(head_parts(F.col("raw_source"), ".", 1).alias("source"), "cause", "total_failed")
    )


def cause_ranking(log: DataFrame, start, end) -> DataFrame:
    """Causes by how often they occur, most frequent first."""
    return (
        on_days(log, submit_day(log), start, end)
        .groupBy("cause")
        .agg(F.count(F.lit(1)).alias("total_failed"))
        .orderBy(F.desc("total_failed"), "cause")
    )


def client_uploads(promo: DataFrame, client: str, start, end) -> DataFrame:
    return on_days(promo, promo_day(promo), start, end).where(
        any_like(F.col("client"), [f"%{client}%"])
    )


UPLOAD_KEYS = ["vendor", "product", "date", "source", "channel", "client"]


def upload_list(promo: DataFrame, client: str, start, end) -> DataFrame:
    """Numbers per vendor, product, day, source, channel and client, by source."""
    return (
        client_uploads(promo, client, start, end)
        .groupBy("vendor", "product", F.substring("date", 1, 10).alias("date"), "source", "channel", "client")
        .agg(F.count("mobileNo").alias("mobile_count"))
        .orderBy("source", "vendor", "product", "date", "channel", "client")
    )


def source_count(promo: DataFrame, client: str, start, end) -> DataFrame:
    """Distinct sources counted month by month, then summed over the months."""
    return (
        client_uploads(promo, client, start, end)
        .groupBy("month")
        .agg((F.count_distinct("source") + F.max(F.col("source").isNull().cast("int"))).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"))
    )


def message_texts(log: DataFrame, month: str | None = None, by_group: bool = False) -> DataFrame:
    """Distinct message texts by day and product, newest first.

    ``by_group`` also tells the sources apart and shows the first two parts of
    their names.
    """
    if month:
        log = log.where(F.col("month") == month)
    keys = [F.substring("submit_time", 1, 10).alias("date"), F.col("text"), F.col("product")]
    if not by_group:
        return log.select(*keys).distinct().orderBy(F.desc("date"), "text", "product")
    return (
        log.select(*keys, "source")
        .distinct()
        .select("date", head_parts(F.col("source"), "_", 2).alias("source"), "text", "product")
        .orderBy(F.desc("date"), "source", "text", "product")
    )


def _done_days(done: DataFrame, client: str, start, end) -> DataFrame:
    rows = on_days(by(done, client=client), _day(done, "submit_date", "date"), start, end)
    return rows.withColumn("date", F.substring("date", 1, 10))


def base_check(done: DataFrame, client: str, start, end) -> DataFrame:
    """The campaigns of a client in a range of days within one month."""
    if str(start)[:7] != str(end)[:7]:
        raise ValueError("both days must lie in the same month")
    return (
        _done_days(done, client, start, end)
        .select("date", "channel", "sender", "source", "base", "product", "client")
        .distinct()
        .orderBy("date", "channel", "sender", "source", "base", "product", "client")
    )


def day_circle_status(done: DataFrame, client: str, start, end) -> DataFrame:
    """Rows of a client by day and circle, in total and by status."""

    def with_status(value: str) -> Column:
        return F.count(F.when(same_text(F.col("status"), value), 1))

    return (
        _done_days(done, client, start, end)
        .groupBy("date", "circle")
        .agg(
            F.count(F.lit(1)).alias("total"),
            with_status("DELIVERED").alias("delivered_count"),
            with_status("FAILED").alias("failed_count"),
            with_status("NOTSENT").alias("notsent_count"),
        )
        .orderBy("date", "circle")
    )


def day_status(promo: DataFrame, day) -> DataFrame:
    """One row: was anything loaded for a day, how many sources, what size.

    The size estimate is 1024 bytes a row. ``day_files`` lists the sources.
    """
    per_source = (
        on_days(promo, promo_day(promo), start=day)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_source.agg(
        (F.count(F.lit(1)) > 0).alias("uploaded"),
        F.lit(str(day)).cast("date").alias("date"),
        F.count(F.lit(1)).alias("source_count"),
        F.coalesce(F.sum("n") * ROW_BYTES, F.lit(0)).alias("size_in_bytes"),
    )


def day_files(promo: DataFrame, day) -> DataFrame:
    """The sources loaded for a day, one row each: a day may hold any number of them."""
    return on_days(promo, promo_day(promo), start=day).select("source").distinct()


def day_totals(log: DataFrame, day) -> DataFrame:
    """Counters of one day over everything."""
    return on_days(log, submit_day(log), start=day).agg(*totals())


def _delivered(log: DataFrame) -> DataFrame:
    return log.where(same_text(F.col("status"), "delivered"))


def delivered_by_circle(log: DataFrame, day) -> DataFrame:
    """Delivered rows of one day by circle."""
    return (
        on_days(_delivered(log), submit_day(log), start=day)
        .groupBy("circle")
        .agg(F.count("status").alias("count"))
    )


def monthly_trend(log: DataFrame) -> DataFrame:
    """Delivered rows by year and month, over all months."""
    rows = _delivered(log)
    day = submit_day(rows)
    return (
        rows.groupBy(F.year(day).alias("year"), F.month(day).alias("month"))
        .agg(F.count(F.lit(1)).alias("total_delivered"))
        .orderBy("year", "month")
    )


def daily_trend(log: DataFrame) -> DataFrame:
    """Delivered rows by day."""
    rows = _delivered(log)
    return (
        rows.groupBy(submit_day(rows).alias("date"))
        .agg(F.count(F.lit(1)).alias("delivered_count"))
        .select("date", F.month("date").alias("month"), F.year("date").alias("year"), "delivered_count")
    )


def campaign_combinations(done: DataFrame, client: str, start, end) -> DataFrame:
    """Distinct day, channel, base and product of a client, newest first."""
    return (
        _done_days(done, client, start, end)
        .select("date", "channel", "base", "product")
        .distinct()
        .orderBy(F.desc("date"), "channel", "base", "product")
    )


def clients(promo: DataFrame, start, end) -> DataFrame:
    """Distinct clients of a range of days, over all its months."""
    return on_days(promo, promo_day(promo), start, end).select("client").distinct()
