"""Idempotent loads of campaign rows into the four stored tables.

The cleaned rows are grouped by month and key and settled once in the shared
folder; the tables are four projections of them, written without another
shuffle. A small ledger holds which (table, month, key, source) was loaded, and only the
months of the batch are read from it. The four tables and the ledger change in one
commit (see ``sources.commits``): a load that is cut short leaves nothing that anyone reads, and
can simply be run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sendledger import schemas as S
from sendledger.functions.dates import day_of, month_of, ms_to_text
from sendledger.functions.predicates import is_dnd
from sendledger.functions.text import nth_field
from sendledger.operators.enrich import mapping_key, with_circle, with_error_text
from sendledger.operators.existence import known_keys, same_messages, unseen
from sendledger.session import in_one_task, scratch, settle, sized
from sendledger.sources.commits import Commits, Entry
from sendledger.sources.reports import NOT_GIVEN
from sendledger.sources.store import grouped, month_text

# FIXED VALUES: channel name and place of the ids in a call-detail record.
CDR_CHANNEL_NAME = "UI"
ENTITY_FIELD = 10
TEMPLATE_FIELD = 11


@dataclass(frozen=True)
class Table:
    folder: str
    schema: T.StructType
    partitions: tuple[str, ...]
    keys: tuple[str, ...]


LOG = Table("message_log", S.MESSAGE_LOG, ("month", "mapping_key"), ("month", "mapping_key", "source"))
DND = Table("dnd", S.DND, ("month", "mapping_key"), ("month", "mapping_key", "source"))
DONE = Table("campaign_done", S.CAMPAIGN_DONE, ("month", "done_key"), ("month", "done_key", "source"))
PROMO = Table("promotions_log", S.PROMOTIONS, ("month",), ("month", "source"))
LOADS = Table("loads", S.LOADS, ("month",), ("folder", "month", "key", "source"))
REJECTED = Table("rejected_files", S.REJECTED, (), ("file_path",))


@dataclass(frozen=True)
class Store:
    """The stored tables below one folder, kept by commits."""

    spark: SparkSession
    root: str

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, self.root)

    def read(self, table: Table, start=None, end=None) -> DataFrame:
        """The table's rows; with ``start``, of the months from its own to that of ``end`` only."""
        if start is None or not table.partitions:
            return self.commits.read(table.folder, table.schema)
        first, last = month_text(start), month_text(end or start)
        rows = self.commits.read(table.folder, table.schema, lambda month: first <= month <= last)
        return rows.where(F.col("month").between(first, last))

    def compact(self, table: Table, **sizes: int) -> list[Entry]:
        """Join the small files that many loads have left (``Commits.compact``)."""
        return self.commits.compact(table.folder, table.schema, table.partitions, **sizes)


def route(
    staged: DataFrame, mapping: DataFrame, sender: str | None = None, month: str | None = None
) -> DataFrame:
    """Typed day, month and table keys for staged rows.

    The month is that of each row's submit time and the message-log key that of
    its sender, unless the load names one month and sender for all its rows.
    """
    rows = staged.withColumn("submit_date", day_of(F.col("submit_time")))
    rows = rows.withColumn("month", F.lit(month) if month else month_of(F.col("submit_time")))
    rows = rows.withColumn("route_sender", F.lit(sender) if sender else F.col("sender"))
    mapping = sized(mapping)  # both keys are looked up in it
    by_sender = mapping.select("id", F.col("sender").alias("route_sender"), "mapping")
    rows = mapping_key(rows, by_sender, "route_sender", "mapping").drop("route_sender")
    return mapping_key(rows, mapping, "client", "log_mapping", out="done_key")


def to_log(df: DataFrame) -> DataFrame:
    return df.select(S.MESSAGE_LOG.names)


def to_dnd(df: DataFrame) -> DataFrame:
    """Do-not-disturb numbers; the source stays along to guard against reloads."""
    return df.where(is_dnd(F.col("cause"))).select(
        "mobileNo", F.col("cause").alias("status"), F.col("submit_time").alias("date"),
        "source", "submit_date", "month", "mapping_key",
    )


def to_done(df: DataFrame) -> DataFrame:
    """Campaign rows, dated by their submit time."""
    return df.withColumn("date", F.col("submit_time")).select(S.CAMPAIGN_DONE.names)


def to_promo(df: DataFrame) -> DataFrame:
    """Promotion rows, dated by their delivery: NULL while undelivered."""
    return (
        df.withColumn("date", F.col("delivered_time"))
        .withColumn("delivered_date", day_of(F.col("delivered_time")))
        .select(S.PROMOTIONS.names)
    )


def _settled_stage(rows: DataFrame) -> DataFrame:
    return settle(grouped(rows, "month", "mapping_key"))


@dataclass(frozen=True)
class Loaded:
    """The sources a load added, and those it found loaded before."""

    sources: list[str]
    duplicates: list[str]


# The column of a stage row that a table's key is taken from; none for a table kept by month only.
KEYS = {LOG.folder: "mapping_key", DND.folder: "mapping_key", DONE.folder: "done_key", PROMO.folder: None}
_LEDGER_FILES = 16  # of a month, beyond which a load joins them


def _keys(stage: DataFrame, tables: list[Table]) -> DataFrame:
    """The batch's keys in each table: folder, month, key, source, each once."""
    keys = stage.groupBy("month", "mapping_key", "done_key", "source").agg(
        F.max(is_dnd(F.col("cause"))).alias("has_dnd")
    )

    def entry(t: Table):
        key = F.col(KEYS[t.folder]) if KEYS[t.folder] else F.lit("")
        mark = F.struct(F.lit(t.folder).alias("folder"), "month", key.alias("key"), "source")
        return F.when(F.col("has_dnd"), mark) if t is DND else mark

    each = keys.select(F.explode(F.array(*[entry(t) for t in tables])).alias("m")).where("m IS NOT NULL").select("m.*")
    return settle(in_one_task(each).distinct())


def ledger_of(store: Store, months: list[str], live: dict[Entry, Entry]) -> DataFrame:
    """The ledger's entries of some months."""
    return store.commits.read(LOADS.folder, LOADS.schema, set(months).__contains__, state=live).where(F.col("month").isin(months))


def _fresh(rows: DataFrame, table: Table, known: DataFrame) -> DataFrame:
    """The rows whose key the ledger does not hold for the table."""
    names = {"key": KEYS[table.folder]} if KEYS[table.folder] else {}
    own = known.where(F.col("folder") == table.folder).withColumnsRenamed(names)
    return unseen(rows, own, list(table.keys))


def _new_ledger(keys: DataFrame, store: Store, live: dict[Entry, Entry], months: list[str]) -> tuple[list[Entry], list[Entry]]:
    """Writes the batch's keys; a month with many small ledger files gets one for all of them."""
    rows, removed = keys.where(F.col("source").isNotNull()).select(LOADS.schema.names), []
    for month in months:
        own = [e for e in live if e.table == LOADS.folder and e.part == f"month={month}"]
        if sum(e.files for e in own) > _LEDGER_FILES:
            rows = rows.unionByName(store.commits.read_entries(own, LOADS.folder, LOADS.schema))
            removed += own
    return store.commits.write(rows.coalesce(1), LOADS.folder, LOADS.partitions), removed


def load_stage(
    stage: DataFrame, store: Store, steps: list[tuple[Table, Callable[[DataFrame], DataFrame]]], deciding: Table
) -> Loaded:
    """Append a settled stage to the tables; the deciding table tells which sources are known.

    Another load that has added one of the same keys meanwhile is a ``Conflict``; then this one is to be repeated.
    """
    commits = store.commits
    base, live = commits.state()
    keys = _keys(stage, [table for table, _ in steps])
    # A load has few months and sources: the driver listed their files.
    found = keys.agg(
        F.collect_set("month").alias("months"),
        F.collect_set(F.when(F.col("folder") == deciding.folder, F.col("source"))).alias("sources"),
        F.max(F.col("source").isNull()).alias("unnamed"),
    ).first()
    known = None
    if any(e.table == LOADS.folder and e.part.removeprefix("month=") in found["months"] for e in live):
        known = settle(known_keys(keys, ledger_of(store, found["months"], live), list(LOADS.keys)))
    counted = known.groupBy("folder").agg(F.collect_set("source").alias("sources")).collect() if known else []
    held = {r["folder"]: set(r["sources"]) for r in counted}
    before = held.get(deciding.folder, set())
    added = set(found["sources"]) - before
    if not added and not found["unnamed"]:
        return Loaded([], sorted(before))
    rows, fresh = stage, keys
    if before:
        listed = known.where(F.col("folder") == deciding.folder).select("source")
        rows, fresh = unseen(stage, listed, ["source"]), unseen(keys, listed, ["source"])
    entries: list[Entry] = []
    for table, project in steps:
        own = _fresh(project(rows), table, known) if held.get(table.folder) else project(rows)
        entries += commits.write(own, table.folder, table.partitions)
    if held:
        fresh = unseen(fresh, known, list(LOADS.keys))
    ledger, joined = _new_ledger(fresh, store, live, found["months"])

    def clash(theirs: list[Entry]) -> bool:
        own = [e for e in theirs if e.table == LOADS.folder]
        return bool(own) and not known_keys(keys, commits.read_entries(own, LOADS.folder, LOADS.schema), list(LOADS.keys)).isEmpty()

    commits.commit(base, entries + ledger, joined, clash)
    return Loaded(sorted(added), sorted(before))


def ingest(
    staged: DataFrame, store: Store, mapping: DataFrame, region: DataFrame,
    sender: str | None = None, month: str | None = None,
) -> Loaded:
    """Load staged rows into all four tables; a source that the message log holds is left out."""
    with scratch(store.spark):
        stage = _settled_stage(route(with_circle(staged, region), mapping, sender, month))
        return load_stage(stage, store, [(DND, to_dnd), (DONE, to_done), (PROMO, to_promo), (LOG, to_log)], LOG)


def ingest_numbers(
    staged: DataFrame, store: Store, mapping: DataFrame, region: DataFrame, date: str
) -> Loaded:
    """Load a number list into the campaign table and the promotions log only."""
    with scratch(store.spark):
        stage = _settled_stage(route(with_circle(staged, region), mapping, month=month_text(date)))
        return load_stage(stage, store, [(PROMO, to_promo), (DONE, to_done)], DONE)


def cdr_rows(cdr: DataFrame, txn: str, campaign: dict[str, str], zone: str = "UTC") -> DataFrame:
    """Call-detail records of a transaction's messages as staged rows.

    The provider code stands as status and as cause until it is translated.
    """
    code = F.col("globalErrorCode").cast("string")
    columns = {
        "transaction_id": F.lit(txn),
        "message_id": F.col("msgId").cast("string"),
        "mobileNo": F.col("mobileNo"),
        "sender": F.col("senderName"),
        "text": F.col("text"),
        "type": F.col("msgType"),
        "length": F.col("length").cast("string"),
        "cost": F.col("cost").cast("string"),
        "status": code,
        "cause": code,
        "channel_name": F.lit(CDR_CHANNEL_NAME),
        "submit_time": ms_to_text(F.col("submitTime"), zone),
        "delivered_time": ms_to_text(F.col("deliveryTime"), zone),
        "ip": F.lit(""),
        "entity_id": nth_field(F.col("additionalData"), ENTITY_FIELD),
        "template_id": nth_field(F.col("additionalData"), TEMPLATE_FIELD),
        "circle": F.lit(NOT_GIVEN),
        **{
            n: F.lit(campaign.get(n)).cast("string")
            for n in ("source", "client", "product", "base", "vendor", "channel")
        },
    }
    return same_messages(cdr, txn).select([columns[n].alias(n) for n in S.STAGED_COLUMNS])


def ingest_cdr(
    cdr: DataFrame, txn: str, campaign: dict[str, str], store: Store, mapping: DataFrame,
    region: DataFrame, codes: DataFrame, zone: str = "UTC",
) -> Loaded:
    """Load the messages of one transaction; an unknown transaction is an error.

    ``campaign`` gives source, client, product, base, vendor, channel, sender and
    the date whose month the rows go to.
    """
    with scratch(store.spark):
        staged = settle(with_error_text(cdr_rows(cdr, txn, campaign, zone), codes, txn))
        if staged.isEmpty():
            raise ValueError(f"transaction {txn} has no call-detail records")
        return ingest(
            staged, store, mapping, region,
            sender=campaign.get("sender"), month=month_text(campaign["date"]),
        )
