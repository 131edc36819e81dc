"""Rows that need a look, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sendledger.functions.text import normal_mobile
from sendledger.operators.enrich import number_series
from sendledger.operators.existence import duplicate_sources
from sendledger.schemas import STAGED_WIDTHS


def duplicate_files(df: DataFrame, stored: DataFrame) -> DataFrame:
    return duplicate_sources(df, stored)


def invalid_numbers(df: DataFrame, number: str = "entry") -> DataFrame:
    """Non-empty entries that are no valid mobile number."""
    c = F.col(number)
    return df.where((F.trim(c) != "") & normal_mobile(c).isNull())


def without_circle(df: DataFrame, region: DataFrame) -> DataFrame:
    """Rows whose number series no circle is known for."""
    known = region.select("series").distinct()
    return df.join(known, number_series(F.col("mobileNo")) == F.col("series"), "left_anti")


def unmapped_codes(df: DataFrame, codes: DataFrame, code: str = "status") -> DataFrame:
    """Provider codes without a mapping and how many rows carry each."""
    found = df.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    known = codes.select(F.lower("code").alias("known")).distinct()
    return found.join(known, F.lower(F.col("code")) == F.col("known"), "left_anti")


def length_violations(df: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Columns with values over their declared width; all columns in one pass."""
    limits = limits or {k: v for k, v in STAGED_WIDTHS.items() if k in df.columns}
    over = {
        name: F.struct(
            F.lit(name).alias("column_name"),
            F.lit(width).alias("max_length"),
            F.count(F.when(F.length(name) > width, 1)).alias("violations"),
            F.max(F.length(name)).alias("longest"),
        )
        for name, width in limits.items()
    }
    counted = df.agg(F.array(*over.values()).alias("columns"))
    return counted.select(F.inline("columns")).where(F.col("violations") > 0)
