"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sendledger.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back (see ``session.settle``)."""
    return settle(df)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` would change other letters, so it serves pure ASCII texts."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def text_key(text: Column) -> Column:
    """128-bit key of a whole text, for joining results that depend on the text alone."""
    return F.unhex(F.md5(text))


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


BITMAP_ROW = 32768  # bits of a row of a bitmap under way


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits, a power of two, with one for each ``hash``."""
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    made = hashes.groupBy(F.expr(f"(hash & {bits - 1}L) div {BITMAP_ROW}").alias("row")).agg(
        F.bitmap_construct_agg((bit % BITMAP_ROW)).alias("bits")
    )
    whole = np.zeros(bits // 8, np.uint8)
    for r in made.collect():  # at most bits / 8 bytes
        whole[r.row * (BITMAP_ROW // 8) : (r.row + 1) * (BITMAP_ROW // 8)] = np.frombuffer(r.bits, np.uint8)
    return whole


def inside(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a bitmap holds."""
    bit = hashes & np.uint64(8 * len(bitmap) - 1)
    return bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
