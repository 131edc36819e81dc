"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
    # Java never compiles a method above 8000 bytecodes. The many cleaned columns
    # of a report make a larger one, which would run interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def builder(app: str = "sendledger", **settings: str) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        b = b.config(key, value)
    return b


def shared_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder the session names, by its setting or on its context."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def use_local_folder(spark: SparkSession) -> None:
    """For tests and single-machine runs: choose a checkpoint folder where none is named."""
    if not shared_folder(spark) and spark.sparkContext.master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))


def work_folder(spark: SparkSession) -> str:
    """A fresh path under the cluster's shared checkpoint folder, which must be named."""
    base = shared_folder(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/sendledger-{uuid.uuid4().hex}"


_SCRATCH = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end, also after an error, whatever was settled inside.

    Rows that are read from settled files must be written before that.
    """
    outer, own = getattr(_SCRATCH, "paths", None), []
    _SCRATCH.paths = own
    try:
        yield
    finally:
        _SCRATCH.paths = outer
        conf = spark._jsc.hadoopConfiguration()
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Two effects: later branches start from files, so a lost executor costs only
    its own tasks, and the optimizer sees the true size, so it broadcasts a
    small result and shuffles a large one without a hint from here. Inside
    ``scratch`` the files go away with the block.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    if getattr(_SCRATCH, "paths", None) is not None:
        _SCRATCH.paths.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ONE_TASK_BYTES = 1 << 20


def _estimated_bytes(df: DataFrame) -> int:
    """The size that the optimizer expects."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def in_one_task(df: DataFrame) -> DataFrame:
    """A table that Spark knows to be small, in one partition: grouping it then needs no shuffle.

    The size is the optimizer's; a larger or unknown table stays as it is.
    """
    return df.coalesce(1) if _estimated_bytes(df) <= ONE_TASK_BYTES else df


def sized(df: DataFrame) -> DataFrame:
    """A table that Spark takes for too large to broadcast, settled so that its true size is seen.

    An aggregate is taken to be about as large as what it reads, however few its groups are; joined by such a
    guess, all rows of a frequent key would meet in one task.
    """
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df if most < 0 or _estimated_bytes(df) <= most else settle(df)


_KEY_BYTES = 64  # of a broadcast row besides its columns


def weighed(keys: DataFrame) -> DataFrame:
    """Keys that are to be looked up, settled, and merged where their rows are too large in memory to broadcast.

    Spark expects a column of a wide table to be as large as its declared width has a share in the files: one of
    a hundred mostly empty columns passes for a hundredth, and files are compressed besides. So the rows are
    counted and their texts measured.
    """
    keys = settle(keys)
    most = keys.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    row = F.lit(_KEY_BYTES + 8 * len(keys.columns))
    for name in keys.columns:
        row = row + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    held = keys.agg(F.sum(row.cast("long"))).first()[0] or 0
    if not held:
        return keys.where("false")  # Spark then knows that there is nothing to look up
    return keys if most < 0 or held <= most else keys.hint("merge")
