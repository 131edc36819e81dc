"""Exact duplicates: local groups, salted groups, then the salt winners, full texts compared.

Every step groups by the digest *and* the text itself, so two texts with one
digest never meet. A task first combines its own copies (the partial side of the
aggregation), the salted groups spread a text that a third of all rows share over
``salts`` tasks, and the last step sees at most ``salts`` rows per text.

Defined results: a null text is the empty text. Of rows with one text the largest
``doc_id`` stays, nulls being smaller than any number; rows that repeat both text
and ``doc_id`` are one document, each reported as kept, and ``keep_one`` returns one
of them. An empty table gives an empty result; other columns are ignored by
``exact_groups`` and carried along by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from sendledger.llm.common import stored


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _salted(docs: DataFrame, salts: int, digest: Callable[[Column], Column], row: Column) -> DataFrame:
    """One row per digest, salt and text: its best row and its size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select(
            digest(text).alias("digest"),
            F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
            text.alias("content"),
            row.alias("best"),
        )
        .groupBy("digest", "salt", "content")
        .agg(F.max("best").alias("best"), F.count("*").alias("size"))
    )


def _combined(salted: DataFrame) -> DataFrame:
    """The salt winners of each text, in the task that holds their digest."""
    return (
        salted.repartition(F.col("digest"))
        .groupBy("digest", "content")
        .agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    )


def exact_groups(
    docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    same = Window.partitionBy("digest")
    winners = _combined(_salted(docs, salts, digest, F.col("doc_id"))).withColumn(
        "texts", F.count("*").over(same)
    )
    winners = stored(
        winners.select(
            "digest", F.col("best").alias("keep_id"), F.col("size").alias("group_size"), "texts",
            F.when(F.col("texts") > 1, F.col("content")).alias("content"),
        )
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", digest(text).alias("digest"), text.alias("content"))
    alone = winners.where("texts = 1").drop("texts", "content")
    if digest is sha256:
        found = rows.drop("content").join(alone, "digest")
        found = found.withColumn("text_sha256", F.lower(F.hex("digest")))
    else:
        found = rows.join(alone, "digest").withColumn("text_sha256", F.sha2("content", 256))
    columns = ["doc_id", "keep_id", "group_size",
               F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    result = found.select(*columns)
    clashing = winners.where("texts > 1")
    if not clashing.isEmpty():  # texts that share a digest are told apart by content
        apart = rows.join(clashing, ["digest", "content"])
        result = result.unionByName(apart.withColumn("text_sha256", F.sha2("content", 256)).select(*columns))
    return result


def keep_one(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The row of ``docs`` that stays for each distinct text, with all its columns.

    The text travels once, as part of the group; the other columns travel beside it.
    """
    others, kinds = [c for c in docs.columns if c != "text"], dict(docs.dtypes)

    def orderable(c: str) -> Column:  # maps have no order, their entries do
        column = F.col(f"`{c}`")
        return (F.array_sort(F.map_entries(column)) if kinds[c].startswith("map<") else column).alias(c)

    def back(c: str) -> Column:
        column = F.col(f"best.row.`{c}`")
        return (F.map_from_entries(column) if kinds[c].startswith("map<") else column).alias(c)

    row = F.struct(
        F.col("doc_id").alias("rank_id"), F.col("text").isNull().alias("no_text"),
        F.struct(*[orderable(c) for c in others]).alias("row"),
    )
    best = _combined(_salted(docs, salts, sha256, row))
    text = F.when(~F.col("best.no_text"), F.col("content")).alias("text")
    return best.select(*[text if c == "text" else back(c) for c in docs.columns])
