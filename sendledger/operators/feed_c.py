"""Lead feed C: the funnel from lead to disbursal by campaign."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sendledger.functions.dates import tail_date
from sendledger.functions.predicates import (
    CHANNEL_DEFAULT, CHANNEL_RULES, campaign_token, channel_filter, label, on_day_tokens,
)
from sendledger.functions.text import same_text

# Stage name, prefix of its measures, column telling transfers from fresh loans.
STAGES = {
    "leads": ("lead", "bt_f"),
    "login": ("login", "bt"),
    "approval": ("approval", "bt"),
    "disbursal": ("disb", "bt"),
}
# FIXED VALUES: the two kinds of loan counted.
TRANSFER = "BT"
FRESH = "Fresh"


def _tagged(stages: dict[str, DataFrame]) -> DataFrame:
    sides = [
        df.select(
            "utm_campaign",
            F.lit(STAGES[name][0]).alias("stage"),
            F.lower(F.col(STAGES[name][1])).alias("kind"),
        )
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, sides)


def _measures() -> list[Column]:
    out = []
    for prefix, _ in STAGES.values():
        here = F.col("stage") == prefix
        transfer = F.count(F.when(here & same_text(F.col("kind"), TRANSFER), 1))
        fresh = F.count(F.when(here & same_text(F.col("kind"), FRESH), 1))
        out += [
            (transfer + fresh).alias(f"{prefix}_count"),
            transfer.alias(f"{prefix}_bt_count"),
            fresh.alias(f"{prefix}_fresh_count"),
        ]
    return out


def funnel(
    stages: dict[str, DataFrame], start, end,
    channel: str | None = None, year: int | None = None, fixed: bool = False,
) -> DataFrame:
    """Loans of both kinds at each stage by campaign, with channel totals.

    All stages are counted in one aggregation. The channel totals per date token
    look for the types ``RC`` and ``SM``, which no campaign has, so they are
    NULL; ``fixed`` looks for ``RCS`` and ``SMS`` and reads JIO tokens right.
    """
    campaign = F.col("utm_campaign")
    year = year or int(str(start)[:4])
    wanted = on_day_tokens(campaign, start, end) & channel_filter(campaign, channel)
    counted = (
        _tagged(stages)
        .groupBy("utm_campaign")
        .agg(*_measures(), F.count(F.lit(1)).alias("rows"))
        # Every group has rows; asking for them keeps the patterns off the raw rows.
        .where(F.when(F.col("rows") > 0, wanted))
        .drop("rows")
        .withColumn("campaign_date", campaign_token(campaign, fixed))
        .withColumn("formatted_date", tail_date(campaign, year))
        .withColumn("campaign_type", label(campaign, CHANNEL_RULES, CHANNEL_DEFAULT))
    )
    if fixed:
        token = Window.partitionBy("campaign_date")  # one row per campaign is left
        for name, kind in (("total_rc_lead_count", "RCS"), ("total_sm_lead_count", "SMS")):
            of_kind = F.when(F.col("campaign_date").isNotNull() & (F.col("campaign_type") == kind), F.col("lead_count"))
            counted = counted.withColumn(name, F.sum(of_kind).over(token))
    else:
        nothing = F.lit(None).cast("bigint")
        counted = counted.withColumn("total_rc_lead_count", nothing).withColumn(
            "total_sm_lead_count", nothing
        )
    names = ["utm_campaign"]
    for prefix, _ in STAGES.values():
        names += [f"{prefix}_count", f"{prefix}_bt_count", f"{prefix}_fresh_count"]
    names += ["campaign_date", "formatted_date", "campaign_type"]
    names += ["total_rc_lead_count", "total_sm_lead_count"]
    return counted.select(names).orderBy("formatted_date", "utm_campaign")


def funnel_rows(stages: dict[str, DataFrame], start, end) -> dict[str, DataFrame]:
    """The rows of each stage in the range, tagged with the stage name."""
    return {
        name: df.where(on_day_tokens(F.col("utm_campaign"), start, end)).withColumn("source", F.lit(name))
        for name, df in stages.items()
    }
