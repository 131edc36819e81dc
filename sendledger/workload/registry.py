"""Queries by name, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sendledger.workload.fixtures import frame, with_blocks

# How the workload writes files that the readers then read.
CSV = {
    "header": True, "escape": '"', "quote": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The sample tables and fixtures of one scale, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)


def query(name: str, uses: tuple[str, ...] = (), sql: str | None = None):
    """Register a query; ``sql`` may refer to the fixtures named in ``uses``."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (with_blocks(*uses) if uses else "") + sql
        return build

    return register


def head(x: str, sep: str, n: int) -> str:
    """First n parts of a text in the SQL twin, last parts for a negative n."""
    part = f"[:{n}]" if n > 0 else f"[{n}:]"
    return f"array_to_string(string_split({x}, '{sep}'){part}, '{sep}')"
