"""Watch a landing folder and load each new delivery report once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from sendledger.operators.existence import unseen
from sendledger.operators.reports import counters
from sendledger.plans.ingest import REJECTED, Store, ingest
from sendledger.session import scratch, settle
from sendledger.sources.reports import read_delivery_reports
from sendledger.sources.commits import Commits
from sendledger.sources.store import read_committed

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
FILES_PER_BATCH = 1000
GLOB_CHARS = r"[\[\]{}*?\\]"


def watch_reports(
    spark: SparkSession,
    folder: str,
    store: Store,
    checkpoint: str,
    campaign: dict[str, str],
    mapping: DataFrame,
    region: DataFrame,
    files_per_batch: int = FILES_PER_BATCH,
    once: bool = True,
) -> StreamingQuery:
    """Stream of file names; every micro-batch loads at most ``files_per_batch`` files.

    Only names travel through the stream (the content column is never read).
    The load skips stored sources, so a batch run again after a failure adds
    nothing twice. Files turned away are noted in the store. ``once`` drains the
    folder and stops.
    """
    names = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select("path")
    )

    def load(batch: DataFrame, _: int) -> None:
        # At most files_per_batch names. The source may give a name with glob
        # characters twice, and readers take names as glob patterns.
        names = [r["path"] for r in batch.distinct().collect()]
        paths = [re.sub(GLOB_CHARS, r"\\\g<0>", name) for name in names]
        if paths:
            with scratch(batch.sparkSession):
                rows, rejected = read_delivery_reports(batch.sparkSession, paths, campaign)
                noted = unseen(rejected, store.read(REJECTED), ["file_path"])
                base, _ = store.commits.state()
                store.commits.commit(base, store.commits.write(noted.select(REJECTED.schema.names), REJECTED.folder, ()))
                ingest(rows, store, mapping, region)

    writer = names.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()


def running_counts(stream: DataFrame) -> DataFrame:
    """Counters by source over a growing message log, for ``keep_counts``; rows without a source are left out."""
    return stream.where("source IS NOT NULL").groupBy("source").agg(*counters())


COUNT_BUCKETS = 64


def keep_counts(counted: DataFrame, path: str, checkpoint: str, buckets: int = COUNT_BUCKETS) -> StreamingQuery:
    """Keep the newest counters of each source in a stored table; drains what is there and stops.

    The table lies in ``buckets`` by a hash of the source. Only the sources of a micro-batch arrive, and only the
    buckets they fall into are written anew and swapped in one commit, so a batch writes in proportion to its
    sources; a batch run again gives the same table. ``kept_counts`` reads it.
    """
    root, table = path.rstrip("/").rsplit("/", 1)
    schema = _counts_schema(counted)

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        commits = Commits(spark, root)
        base, live = commits.state()
        with scratch(spark):
            bucket = F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("string")
            changed = settle(batch.withColumn("bucket", bucket).select(schema.names))
            touched = {f"bucket={r['bucket']}" for r in changed.select("bucket").distinct().collect()}
            old = [e for e in live if e.table == table and e.part in touched]
            kept = commits.read_entries(old, table, schema).join(changed.select("source"), "source", "left_anti")
            merged = kept.select(schema.names).unionByName(changed).repartition("bucket")
            commits.commit(base, commits.write(merged, table, ("bucket",)), old, lambda theirs: any(e.table == table for e in theirs))

    writer = counted.writeStream.outputMode("update").foreachBatch(merge)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _counts_schema(counted: DataFrame) -> T.StructType:
    return T.StructType([*counted.schema.fields, T.StructField("bucket", T.StringType())])


def kept_counts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The counters that ``keep_counts`` holds."""
    rows = read_committed(spark, path, T.StructType([*schema.fields, T.StructField("bucket", T.StringType())]))
    return rows.select(schema.names)


def hourly_counts(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Counters by source and hour of submission, closed once ``lateness`` has passed."""
    moment = F.col("submit_time").try_cast("timestamp")
    return (
        stream.withColumn("submit_ts", moment)
        .withWatermark("submit_ts", lateness)
        .groupBy("source", F.window("submit_ts", "1 hour").alias("hour"))
        .agg(*counters())
    )


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A stored table as a stream of its new files."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )
