"""Lead feed B: counts by day, camp type and referrer."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from sendledger.functions.predicates import on_days
from sendledger.functions.text import lead_float, one_of, same_text
from sendledger.operators.reports import tally

# FIXED VALUES: texts of the qualification rules.
OTHER_CITIES = "Other Cities"
DONE_PREFIX = "appointment%"
DONE_STATUS = ["callback", "follow up"]
RETRY_STATUS = ["busy", "ringing no response"]
RETRY_ATTEMPTS = [1, 2, 3]
ALL = "All"


def _same_month(start, end) -> None:
    if str(start)[:7] != str(end)[:7]:
        raise ValueError("both days must lie in the same month")


def camp_filter(
    camp: str | None = None, camp_type: str | None = None, ref: str | None = None
) -> Column:
    """The camp-type condition of a request with two optional type inputs."""
    column = F.col("camp_type")
    if OTHER_CITIES in (camp_type or "") or OTHER_CITIES in (camp or ""):
        wanted = column.ilike(f"%{OTHER_CITIES}%")
        if ref and ref != ALL:
            wanted = wanted & F.col("reffer_id_source").ilike(f"%{ref}%")
        return wanted
    ends = [camp, camp_type if camp_type != ALL else None]
    conditions = [F.trim(column).ilike(f"%{e}") for e in ends if e]
    return reduce(or_, conditions) if conditions else F.lit(True)


def feed_b_counts(
    leads: DataFrame, start, end,
    camp: str | None = None, camp_type: str | None = None, ref: str | None = None,
) -> DataFrame:
    """Qualified, not qualified and all leads by day, camp type and referrer."""
    _same_month(start, end)
    # Counted by full referrer first, so that rows are hashed and not sorted.
    counted = (
        on_days(leads, "lead_date", start, end)
        .where(camp_filter(camp, camp_type, ref))
        .groupBy("lead_date", "camp_type", "reffer_id_source")
        .agg(
            tally(same_text(F.col("lead_category"), "NQL")).alias("NQL"),
            tally(same_text(F.col("lead_category"), "QL")).alias("QL"),
            F.count(F.lit(1)).alias("total_leads"),
        )
    )
    short = F.substring_index("reffer_id_source", "-", -2).alias("extracted_reffer_id")
    return (
        counted.groupBy("lead_date", "camp_type", short)
        .agg(
            F.min("reffer_id_source").alias("reffer_id_source"),
            *[F.sum(c).alias(c) for c in ("NQL", "QL", "total_leads")],
        )
        .orderBy("lead_date", "camp_type", "extracted_reffer_id")
    )


def feed_b_rows(leads: DataFrame, start, end, camp: str | None = None) -> DataFrame:
    """Rows of a range of days, optionally of camp types holding a text."""
    _same_month(start, end)
    rows = on_days(leads, "lead_date", start, end)
    return rows.where(F.col("camp_type").ilike(f"%{camp}%")) if camp else rows


def _target() -> Column:
    return F.col("camp_type").ilike(f"%{OTHER_CITIES}%") & same_text(F.col("tg"), "yes")


def _settled() -> Column:
    status = F.col("lead_status")
    return _target() & (status.ilike(DONE_PREFIX) | one_of(status, DONE_STATUS))


def _retry() -> Column:
    # A text is compared with numbers by the number it starts with.
    attempts = lead_float(F.col("no_of_call_attempts"))
    return _target() & one_of(F.col("lead_status"), RETRY_STATUS) & attempts.isin(RETRY_ATTEMPTS)


def feed_b_qualified(leads: DataFrame, part: str = "all") -> DataFrame:
    """Qualified leads by day: all, only those to retry, or both halves summed."""
    counted = lambda condition: (
        leads.where(condition)
        .groupBy("lead_date")
        .agg(F.count(F.lit(1)).alias("count_of_lead_category"))
    )
    if part == "all":
        return counted(_settled() | _retry())
    if part == "retry":
        return counted(_retry())
    if part == "total":
        # The two status sets exclude each other: one pass counts both halves.
        halves = leads.where(_settled() | _retry())
        return halves.groupBy("lead_date").agg(
            (
                tally(F.coalesce(_settled(), F.lit(False)))
                + tally(F.coalesce(_retry(), F.lit(False)))
            ).alias("total_cpql")
        )
    raise ValueError("part must be all, retry or total")
