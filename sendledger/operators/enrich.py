"""Joins that add to a row without ever adding a row.

Each dimension is reduced to one row per key first. No broadcast hint is given:
Spark broadcasts a dimension whose size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, with
skewed keys split by adaptive execution. A dimension that Spark takes for larger than that is
settled first (``sized``), as a few groups may have been made from a large table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sendledger.functions.text import name_key, same_text
from sendledger.session import in_one_task, sized


def number_series(mobile: Column) -> Column:
    """The four digits after the country code."""
    return F.substring(mobile, 3, 4)


def one_circle(region: DataFrame) -> DataFrame:
    return sized(in_one_task(region).groupBy("series").agg(F.min("circle").alias("new_circle")))


def with_circle(df: DataFrame, region: DataFrame) -> DataFrame:
    """Circle by number series; an unmatched number keeps its circle."""
    dim = one_circle(region).withColumn("matched", F.lit(True))
    joined = df.join(dim, number_series(F.col("mobileNo")) == F.col("series"), "left")
    circle = F.when(F.col("matched"), F.col("new_circle")).otherwise(F.col("circle"))
    return joined.withColumn("circle", circle).select(df.columns)


def one_error_text(codes: DataFrame) -> DataFrame:
    """One status and cause per code, the smallest pair."""
    return sized(
        in_one_task(codes)
        .groupBy(F.lower("code").alias("code_key"))
        .agg(F.min(F.struct("status", "cause")).alias("text"))
        .select("code_key", F.col("text.status").alias("new_status"), F.col("text.cause").alias("new_cause"))
    )


def with_error_text(df: DataFrame, codes: DataFrame, txn: str | None = None) -> DataFrame:
    """Provider code in ``status`` replaced by its status and cause texts.

    With ``txn`` only rows of that transaction change.
    """
    dim = one_error_text(codes).withColumn("matched", F.lit(True))
    joined = df.join(dim, F.lower(F.col("status")) == F.col("code_key"), "left")
    change = F.coalesce(F.col("matched"), F.lit(False))
    if txn is not None:
        change = change & F.coalesce(F.col("transaction_id") == F.lit(txn), F.lit(False))
    return joined.select(
        *[
            F.when(change, F.col(f"new_{n}")).otherwise(F.col(n)).alias(n)
            if n in ("status", "cause")
            else F.col(n)
            for n in df.columns
        ]
    )


def mapping_key(
    df: DataFrame,
    mapping: DataFrame,
    on: str,
    value: str,
    out: str = "mapping_key",
    fallback: bool = True,
) -> DataFrame:
    """The mapped name of a sender or client; the row with the lowest id counts.

    Without a mapping the name itself with blanks as underscores is used, or
    NULL if ``fallback`` is off.
    """
    dim = sized(
        in_one_task(mapping)
        .groupBy(F.lower(on).alias("lookup"))
        .agg(F.min_by(value, "id").alias("found"))
    )
    joined = df.join(dim, F.lower(df[on]) == F.col("lookup"), "left")
    key = F.coalesce(F.col("found"), name_key(df[on])) if fallback else F.col("found")
    return joined.select(*[df[c] for c in df.columns if c != out], key.alias(out))


def mapped_name(mapping: DataFrame, on: str, name: str, value: str) -> DataFrame:
    """The mapping of one named sender or client, if any: at most one row."""
    return mapping.where(same_text(F.col(on), name)).orderBy("id").limit(1).select(value)
