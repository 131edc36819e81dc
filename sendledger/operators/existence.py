"""Rows kept or dropped by what another table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sendledger.functions.text import same_text


def known_keys(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``df`` that ``stored`` holds, each once.

    Both sides are made distinct before they meet, so a hot source crosses the
    shuffle as one row per task.
    """
    return df.select(*keys).distinct().join(stored.select(*keys).distinct(), keys, "left_semi")


def unseen(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not stored; a NULL key always passes."""
    return df.join(stored.select(*keys).distinct(), keys, "left_anti")


def duplicate_sources(df: DataFrame, stored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sources of a batch that were loaded before."""
    return known_keys(df, stored, keys or ["source"]).select("source").distinct()


def same_messages(cdr: DataFrame, uuid: str) -> DataFrame:
    """All records sharing a message id with a transaction."""
    ids = cdr.where(same_text(F.col("uuId"), uuid)).select("msgId").distinct()
    return cdr.join(ids, "msgId", "left_semi").select(cdr.columns)


def drop_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return df.join(known.select(key).distinct(), key, "left_anti").select(df.columns)
