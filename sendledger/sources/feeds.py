"""Lead sheets (one CSV per sheet) and message templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sendledger import schemas as S
from sendledger.functions.dates import (
    DAY_MONTH_NAME, ISO_DAY, ISO_SECOND, US_DAY, sheet_date, try_date,
)
from sendledger.session import settle
from sendledger.sources.csv_rows import csv_cells, file_heads, header_names, named_cells, read_lines

# FIXED VALUES: headers of a template file and the columns they fill.
TEMPLATE_HEADERS = {"TemplateId": "tempid", "Sender": "sender", "Count": "count", "Text": "text"}


def sheet_path(folder: str, feed: str, kind: str) -> str:
    """Where the CSV of a sheet lies: one file per kind of sheet."""
    if kind not in S.SHEETS[feed]:
        raise ValueError(f"feed {feed} has no sheet {kind}")
    return f"{folder.rstrip('/')}/{kind}.csv"


def typed_feed(rows: DataFrame, feed: str, kind: str) -> DataFrame:
    """Text columns of a sheet with its dates and amounts typed.

    Empty text stays empty; an unreadable date or amount is NULL.
    """
    key = (feed, kind)
    names = S.FEEDS[key]

    def typed(name: str) -> Column:
        c = F.col(name)
        if name == names[0]:
            c = sheet_date(c)
        if name in S.ISO_DAYS.get(key, []):
            return try_date(c, ISO_DAY)
        if name in S.NAMED_DAYS.get(key, []):
            return try_date(c, DAY_MONTH_NAME, ISO_DAY)
        if name in S.SECONDS.get(key, []):
            return F.try_to_timestamp(F.nullif(c, F.lit("")), F.lit(ISO_SECOND)).cast("timestamp_ntz")
        if name in S.US_DAYS.get(key, []):
            return try_date(c, *US_DAY)
        if name in S.DECIMALS.get(key, []):
            return c.try_cast("decimal(10,2)")
        return F.coalesce(c, F.lit(""))

    return rows.select(
        *[typed(n).alias(n) for n in names],
        *[c for c in rows.columns if c not in names],
    )


def read_feed(spark: SparkSession, path, feed: str, kind: str) -> DataFrame:
    """One sheet, columns by position, plus ``file_path, block, pos`` for its order."""
    names = S.FEEDS[(feed, kind)]
    rows = csv_cells(spark, path, len(names)).select(
        "file_path", "block", "pos",
        *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)],
    )
    return typed_feed(rows, feed, kind)


def read_templates(spark: SparkSession, path) -> DataFrame:
    """Templates by header name; a missing column or value is empty text."""
    lines = read_lines(spark, path)
    heads = file_heads(lines).select(
        "file_path", "is_closed", header_names(F.col("header")).alias("names")
    )
    heads = settle(heads)
    unclosed = heads.where("NOT is_closed").first()
    if unclosed:
        raise ValueError(f"file ends inside a quoted cell: {unclosed['file_path']}")
    rows = named_cells(lines, heads, list(TEMPLATE_HEADERS))
    return rows.select(
        [F.coalesce(F.col(h), F.lit("")).alias(n) for h, n in TEMPLATE_HEADERS.items()]
    )
