"""Lines found in many documents leave every document; the other lines stay in place.

Lines are normalised, hashed and exploded; each text is exploded once with the
number of rows that hold it, so copies of a document do not multiply. A second
explode by position finds the dropped lines of each text, and the texts are put
together again by position. Built-in functions only.

Defined results: a document is a row, so repeated rows and rows without
``doc_id`` count one each. A null or empty text is one empty line. Keys shorter than
``min_chars`` code points are never dropped. A text whose lines all go becomes
empty. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sendledger.llm.common import SPACES, ascii_lower, stored, text_key

_SALTS = 8


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per distinct text: its key, its rows, and the hash of each line (null: too short)."""

    def digest(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))

    rows = docs.select(
        text_key(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"),
        F.transform(_lines(), digest).alias("hashes"),
    )
    return rows.groupBy("text_key").agg(F.first("hashes").alias("hashes"), F.count("*").alias("rows"))


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(text_key, dropped): the positions of the lines each text loses."""
    texts = stored(_hashed(docs, min_chars))
    frequent = (
        texts.select("rows", F.explode(F.array_distinct("hashes")).alias("hash"))
        .where("hash IS NOT NULL")
        .groupBy("hash")
        .agg(F.sum("rows").alias("docs"))
        .where(F.col("docs") >= min_docs)
        .select("hash")
    )
    # A line may stand in a third of all texts: its places are dealt over several tasks.
    frequent = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    placed = (
        texts.select("text_key", F.posexplode("hashes").alias("pos", "hash"))
        .where("hash IS NOT NULL")
        .withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(_SALTS)).cast("int"))
    )
    return placed.join(frequent, ["hash", "salt"]).groupBy("text_key").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (before), n_dropped, kept (the text that stays)."""
    drops = dropped_lines(docs, min_docs, min_chars)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text_key(text).alias("text_key"))
    rows = rows.join(drops, "text_key", "left").withColumn("lines", F.split("text", "\n", -1))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    rest = F.transform(F.array_except(places, F.col("dropped")), lambda i: F.get("lines", i))
    return rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("kept"),
    )
