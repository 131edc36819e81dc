"""Month-partitioned Parquet tables, small versioned tables, and the upload ledger."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sendledger.functions.text import same_text
from sendledger.schemas import CDR, LEDGER
from sendledger.sources.commits import Commits, no_rows


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or no rows when nothing was written yet.

    The schema is given, so a key such as ``007`` keeps its text form.
    """
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return no_rows(spark, schema)


def grouped(df: DataFrame, *partitions: str) -> DataFrame:
    """Rows brought together by partition before a write.

    The rebalance splits a partition that holds much of the data over many
    tasks and joins small ones, so neither one task nor many tiny files result.
    """
    return df.hint("rebalance", *partitions)


def write_month_partitioned(
    df: DataFrame,
    path: str,
    partitions: tuple[str, ...] = ("month", "mapping_key"),
    is_grouped: bool = False,
) -> None:
    """Append by partition; rows that are grouped already are not shuffled again."""
    rows = df if is_grouped else grouped(df, *partitions)
    rows.write.partitionBy(*partitions).mode("append").parquet(path)


def month_text(day: date | str) -> str:
    return str(day)[:7]


def read_months(df: DataFrame, start, end) -> DataFrame:
    """Rows whose month lies in the range, both ends included; prunes partitions."""
    return df.where(F.col("month").between(month_text(start), month_text(end)))


def write_cdr(df: DataFrame, path: str) -> None:
    write_month_partitioned(df, path, ("cdr_date",))


def read_cdr(spark: SparkSession, path: str, day) -> DataFrame:
    """Call-detail records of one day; reads that day's partition only."""
    return read_table(spark, path, CDR).where(F.col("cdr_date") == F.lit(str(day)).cast("date"))


# --- small tables that are replaced as a whole -------------------------------------

VERSION = T.StructType(
    [T.StructField("version", T.LongType()), T.StructField("folder", T.StringType())]
)


def read_current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version of a table kept by ``replace_table``."""
    newest = (
        read_table(spark, f"{path}/versions", VERSION).orderBy(F.desc("version")).limit(1).collect()
    )
    if not newest:
        return no_rows(spark, schema)
    return read_table(spark, f"{path}/{newest[0]['folder']}", schema)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version beside the old one, then name it the current one.

    ``df`` may be derived from the version in use: no path is overwritten. A version
    number is claimed by creating a file, which only one of two writers can do;
    the other must read the new version and start again.
    """
    spark = df.sparkSession
    newest = read_table(spark, f"{path}/versions", VERSION).agg(F.max("version")).first()[0] or 0
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/claims/{newest + 1}")
    files = claim.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(claim.getParent())
    if not files.createNewFile(claim):
        raise RuntimeError(f"version {newest + 1} of {path} is being written by another load")
    try:
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{folder}")
        spark.createDataFrame([(newest + 1, folder)], VERSION).write.mode("append").parquet(
            f"{path}/versions"
        )
    finally:
        files.delete(claim, False)


def replace_month(df: DataFrame, path: str, month: str, column: str = "month") -> None:
    """Replace one month of a feed by ``df``, also when ``df`` holds no row.

    The new rows are written beside the old ones and swapped for them in one commit, so a reader finds the
    old month or the new one, also if this is cut short.
    """
    root, table = path.rstrip("/").rsplit("/", 1)
    commits = Commits(df.sparkSession, root)
    base, live = commits.state()
    commits.commit(base, *month_change(commits, live, df, table, month, column))


def month_change(commits: Commits, live: dict, df: DataFrame, table: str, month: str, column: str) -> tuple[list, list]:
    """The entries to add and to remove for a month that ``df`` replaces."""
    added = commits.write(df.withColumn(column, F.lit(month)), table, (column,))
    old = commits.write_name(column, month)
    return added, [e for e in live if e.table == table and e.part == old]


def read_committed(spark: SparkSession, path: str, schema: T.StructType, months=None, column: str = "month") -> DataFrame:
    """The live rows of a table kept by commits, of the months that ``months`` accepts if given."""
    root, table = path.rstrip("/").rsplit("/", 1)
    return Commits(spark, root).read(table, schema, months, column)


# --- upload ledger -----------------------------------------------------------------


def ledger_filter(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose name is not in the ledger yet."""
    return files.join(ledger.select("filename").distinct(), "filename", "left_anti")


def ledger_rows(files: DataFrame) -> DataFrame:
    """``date, filename, filepath`` rows, stamped with the present time."""
    return files.withColumn("uploaded_at", F.localtimestamp()).select(LEDGER.names)


def ledger_append(files: DataFrame, path: str) -> None:
    """Add ``date, filename, filepath`` rows."""
    ledger_rows(files).write.mode("append").parquet(path)


def files_for_month(ledger: DataFrame, mon: str) -> DataFrame:
    """Ledger rows whose file name holds the month word."""
    return ledger.where(F.col("filename").ilike(f"%{mon}%"))


def distinct_values(df: DataFrame, column: str, channel: str | None = None) -> DataFrame:
    """The distinct values of a column, of one channel if named."""
    if channel:
        df = df.where(same_text(F.col("channel"), channel))
    return df.select(column).distinct()
