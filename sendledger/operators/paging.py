"""Pages over an upload list, keyed by source.

A page is a set of sources with all their rows, so no row is lost where a
source has several rows at a page edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sendledger.operators.reports import client_uploads

PAGE_SIZE = 10


def _after(cursor: str | None, direction: str) -> Column:
    if not cursor:
        return F.lit(True)
    return F.col("source") < cursor if direction == "prev" else F.col("source") > cursor


def _order(direction: str) -> Column:
    return F.desc("source") if direction == "prev" else F.asc("source")


def page(
    df: DataFrame, cursor: str | None = None, limit: int = PAGE_SIZE, direction: str = "next"
) -> DataFrame:
    """Rows of the next (or previous) ``limit`` sources after ``cursor``, ascending.

    The sources of the page are found first, from their column alone; the rows then meet these few names and
    are sorted by ranges, so a source with a large part of the rows goes through no single task. The cursor is a
    condition on a grouping key, so it reaches both scans. Rows without a source stay on the first page.
    """
    rest = [c for c in df.columns if c != "source"]
    rows = df.where(_after(cursor, direction))
    chosen = rows.select(F.col("source").alias("chosen")).distinct().orderBy(
        F.desc("chosen") if direction == "prev" else F.asc("chosen")
    ).limit(limit)
    return rows.join(chosen, F.col("source").eqNullSafe(F.col("chosen")), "left_semi").orderBy("source", *rest)


def page_info(
    promo: DataFrame, client: str, start, end,
    limit: int = PAGE_SIZE, cursor: str | None = None, direction: str = "next",
) -> DataFrame:
    """One row about a page of a client's uploads: totals, cursors, and whether there is more.

    Totals and page come from one list of months and sources, so the rows are read once.
    """
    pairs = client_uploads(promo, client, start, end).select("month", "source").distinct()
    none = {"total_records": "bigint", "first_cursor": "string", "last_cursor": "string", "page_sources": "bigint"}

    def row(df: DataFrame, **found: Column) -> DataFrame:
        return df.agg(*[found.get(n, F.lit(None).cast(t)).alias(n) for n, t in none.items()])

    sources = pairs.where(_after(cursor, direction)).select("source").distinct().orderBy(_order(direction)).limit(limit)
    here = row(
        sources, first_cursor=F.min("source"), last_cursor=F.max("source"), page_sources=F.count(F.lit(1))
    )
    merged = here.unionByName(row(pairs, total_records=F.count(F.lit(1)))).agg(*[F.max(n).alias(n) for n in none])
    current = "1" if not cursor else ("Previous" if direction == "prev" else "Next")
    return merged.select(
        "total_records",
        F.ceil(F.col("total_records") / F.lit(limit)).cast("bigint").alias("total_pages"),
        F.lit(current).alias("current_page"),
        F.col("first_cursor").alias("first_page_cursor"),
        F.col("last_cursor").alias("last_page_cursor"),
        F.col("first_cursor").alias("previous_cursor"),
        F.col("last_cursor").alias("next_cursor"),
        (F.col("page_sources") == limit).alias("has_next"),
        F.lit(bool(cursor)).alias("has_previous"),
    )
