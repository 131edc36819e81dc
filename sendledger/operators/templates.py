"""Message templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sendledger.functions.text import scrub, strip_quote
from sendledger.operators.existence import drop_known
from sendledger.schemas import TEMPLATES


def _plain_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("tempid", strip_quote(F.col("tempid")))


def refresh_templates(
    stored: DataFrame, new: DataFrame, transactional: DataFrame, kind: str, month: str
) -> DataFrame:
    """Stored templates with a new batch in place of those it repeats.

    Templates on the transactional list are left out. Ids lose their quote
    before they are compared, so the same file read twice changes nothing.
    """
    batch = (
        _plain_ids(new)
        .withColumn("type", F.lit(kind))
        .withColumn("month", scrub(F.lit(month)))
        .select(TEMPLATES.names)
    )
    kept = drop_known(_plain_ids(stored).select(TEMPLATES.names), batch, "tempid")
    return drop_known(kept.unionByName(batch), _plain_ids(transactional.select("tempid")), "tempid")
