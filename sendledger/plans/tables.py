"""Changes to the small tables: product mapping and message templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sendledger.operators.mapping import add_mappings, update_mapping
from sendledger.operators.templates import refresh_templates
from sendledger.schemas import MAPPING, TEMPLATES
from sendledger.session import scratch, settle
from sendledger.sources.feeds import read_templates
from sendledger.sources.store import read_current, replace_table


def save_mappings(new: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Store new mapping entries; returns those added and those that existed."""
    mapping = read_current(new.sparkSession, path, MAPPING)
    added, exists = add_mappings(mapping, new)
    added, exists = settle(added), settle(exists)
    replace_table(mapping.unionByName(added), path)
    return added, exists


def change_mappings(changes: DataFrame, path: str) -> None:
    """Store changed mapping entries."""
    replace_table(update_mapping(read_current(changes.sparkSession, path, MAPPING), changes), path)


def load_templates(
    spark: SparkSession, csv_path: str, path: str, transactional: DataFrame, kind: str, month: str
) -> None:
    """Refresh the stored templates from a CSV file."""
    stored = read_current(spark, path, TEMPLATES)
    with scratch(spark):
        new = read_templates(spark, csv_path)
        replace_table(refresh_templates(stored, new, transactional, kind, month), path)
