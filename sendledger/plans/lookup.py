"""From a sender or client to its stored rows: name, mapped key, pruned partitions.

The stored tables lie by month and by the key that the product mapping gives a name, so a
report of one name over some days reads a few folders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sendledger.functions.text import name_key
from sendledger.operators.enrich import mapped_name
from sendledger.operators.reports import base_check
from sendledger.plans.ingest import DONE, LOG, Store, Table

# Which column of the mapping names a table's key, by what the key is looked up, and the key's column.
_LOOKUPS = {LOG.folder: ("sender", "mapping", "mapping_key"), DONE.folder: ("client", "log_mapping", "done_key")}


def table_key(mapping: DataFrame, table: Table, name: str, fallback: bool = True) -> str | None:
    """The key of a sender or client in a table; unmapped names keep their own if ``fallback``."""
    on, value, _ = _LOOKUPS[table.folder]
    found = mapped_name(mapping, on, name, value).first()
    if found and found[0] is not None:
        return found[0]
    return mapping.sparkSession.range(1).select(name_key(F.lit(name))).first()[0] if fallback else None


def stored_rows(
    store: Store, table: Table, mapping: DataFrame, name: str, start=None, end=None, fallback: bool = True
) -> DataFrame:
    """A table's rows of one sender (message log) or client (campaign table), months of the range only.

    Without ``fallback`` an unmapped name is an error.
    """
    key = table_key(mapping, table, name, fallback)
    if key is None:
        raise LookupError(f"no mapping for {name}")
    return store.read(table, start, end).where(F.col(_LOOKUPS[table.folder][2]) == key)


def client_base(store: Store, mapping: DataFrame, client: str, start, end) -> DataFrame:
    """The campaigns of a client (``base_check``); an unmapped client or an empty answer is an error."""
    found = base_check(stored_rows(store, DONE, mapping, client, start, end, fallback=False), client, start, end)
    if found.isEmpty():
        raise LookupError(f"no rows for {client} from {start} to {end}")
    return found
