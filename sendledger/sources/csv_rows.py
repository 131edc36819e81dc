"""CSV files as rows of text cells, whatever their size or header.

A quoted cell may hold line ends, so where a record begins depends on all the quotes
before it. The text is read once, as lines in ordinary splits, and settled with what
each line does to the state "inside a quoted cell": most lines leave it alone or end
outside whatever came before, some open a cell. The effects of a split's lines
are composed, one row per split is carried through each file, and only splits that
hold quoted line ends are put together from several lines. How a file is split
makes no difference to its rows.

A quote opens a cell only at the start of a cell; anywhere else it is plain text.
A file that ends inside a quoted cell, or whose quoted cell runs over more than
``LONGEST_RECORD`` bytes, is not read at all: ``files`` tells which.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sendledger.functions.text import strip
from sendledger.session import settle

CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
OUTSIDE_QUOTES_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*\z)'
# Distance between the splits of a quoted cell's first and last line: a text cell
# is far shorter, a stray quote at the start of a cell makes a longer one.
LONGEST_RECORD = 256 * 1024 * 1024
# Splits with quoted line ends that may be broadcast, about 20 MB.
SPLITS_AT_ONCE = 100_000

# What a line does to the state: leave it, end outside, end inside, turn it round.
SAME, OUTSIDE, INSIDE, TURN = range(4)


# Text of a quoted cell up to a lone quote or the end of the line; a cell outside quotes or closed on its line.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?:(?:[^",][^,]*+)?+,|"{_QUOTED}"[^,]*+,)*+'
# Lines that end inside a quoted cell, begun outside or inside one.
_OPENS = rf'^{_CELLS}"{_QUOTED}\z'
_STAYS = rf'^{_QUOTED}(?:\z|"[^,]*+,{_CELLS}"{_QUOTED}\z)'


def _effect(line: Column) -> Column:
    """The state after a line, for either state before it, as one of the four effects.

    Outside, a cell that begins with a quote runs to the next lone quote, and what follows that up to the
    comma is text; inside, a lone quote ends the cell. One pass of a pattern without backtracking tells
    each state.
    """
    opens, stays = F.rlike(line, F.lit(_OPENS)), F.rlike(line, F.lit(_STAYS))
    effect = F.when(opens, F.when(stays, INSIDE).otherwise(TURN)).otherwise(F.when(stays, SAME).otherwise(OUTSIDE))
    return F.when(F.contains(line, F.lit('"')), effect).otherwise(SAME)


@dataclass(frozen=True)
class Lines:
    """The settled lines of some files, their splits and the files themselves.

    ``rows``: file_path, block, pos, value, effect. ``splits``: file_path, block, starts_inside,
    is_open, opened (the place of the record open at its start). ``files``: file_path, head (the
    place of the first line), is_closed.
    """

    rows: DataFrame
    splits: DataFrame
    files: DataFrame


def _with_effects(df: DataFrame, order) -> DataFrame:
    """``is_fixed`` and ``value`` of the effects up to and including each row."""
    turns = F.sum(F.when(F.col("effect") == TURN, 1).otherwise(0)).over(order)
    df = df.withColumn("turns", turns).withColumn(
        "fixed",
        F.when(F.col("effect").isin(OUTSIDE, INSIDE), F.struct((F.col("effect") == INSIDE).alias("value"), F.col("turns").alias("turns"))),
    )
    last = F.last("fixed", ignorenulls=True).over(order)
    df = df.withColumn("last", last)
    turned = F.pmod(F.col("turns") - F.coalesce("last.turns", F.lit(0)), F.lit(2)) == 1
    return df.withColumn("is_fixed", F.col("last").isNotNull()).withColumn(
        "value", F.coalesce("last.value", F.lit(False)) != turned
    ).drop("turns", "fixed", "last")


def read_lines(spark: SparkSession, paths) -> Lines:
    """Read the files once; everything after works on the settled lines."""
    rows = settle(
        spark.read.text(paths).select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
            # Rising within a split; splits are ordered by their start.
            F.monotonically_increasing_id().alias("pos"),
            "value",
            _effect(F.col("value")).alias("effect"),
        )
    )
    in_split = W.partitionBy("file_path", "block").orderBy("pos")
    in_file = W.partitionBy("file_path").orderBy("block")
    # Only lines with quotes are sorted, without their text.
    quoted = _with_effects(
        rows.where(F.col("effect") != SAME).select("file_path", "block", "pos", "effect"), in_split
    )
    ends = quoted.groupBy("file_path", "block").agg(
        F.max_by(F.struct("is_fixed", "value"), "pos").alias("end"),
        F.max((F.col("effect") > OUTSIDE).cast("int")).alias("opens"),
    )
    end_effect = F.when(F.col("end.is_fixed"), F.when(F.col("end.value"), INSIDE).otherwise(OUTSIDE)).when(
        F.col("end.value"), TURN
    )
    splits = (
        rows.groupBy("file_path", "block")
        .agg(F.min("pos").alias("first"))
        .join(ends, ["file_path", "block"], "left")
        .withColumn("effect", F.coalesce(end_effect, F.lit(SAME)))
    )
    splits = _with_effects(splits, in_file)  # a file starts outside, so the value is the state
    splits = splits.withColumn("starts_inside", F.coalesce(F.lag("value").over(in_file), F.lit(False)))
    splits = settle(
        splits.select(
            "file_path", "block", "first", "starts_inside", F.col("value").alias("ends_inside"),
            (F.col("starts_inside") | (F.coalesce("opens", F.lit(0)) == 1)).alias("is_open"),
        )
    )
    state = F.when(F.col("is_fixed"), F.col("value")).otherwise(F.col("starts_inside") != F.col("value"))
    before = F.coalesce(F.lag("after").over(in_split), F.col("starts_inside"))
    opened = (
        quoted.join(splits.where("is_open").select("file_path", "block", "starts_inside"), ["file_path", "block"])
        .withColumn("after", state)
        .withColumn("before", before)
        .where("after AND NOT before")
        .groupBy("file_path", "block")
        .agg(F.max("pos").alias("last_opened"))
    )
    place = F.when(F.col("last_opened").isNotNull(), F.struct("block", F.col("last_opened").alias("pos")))
    earlier = in_file.rowsBetween(W.unboundedPreceding, -1)
    splits = settle(
        splits.join(opened, ["file_path", "block"], "left").withColumn(
            "opened", F.when(F.col("starts_inside"), F.last(place, ignorenulls=True).over(earlier))
        )
    )
    files = splits.groupBy("file_path").agg(
        F.min_by("first", "block").alias("head"),
        (
            ~F.max_by("ends_inside", "block")
            & (F.coalesce(F.max(F.col("block") - F.col("opened.block")), F.lit(0)) <= LONGEST_RECORD)
        ).alias("is_closed"),
    )
    return Lines(rows, splits, settle(files))


def file_heads(lines: Lines) -> DataFrame:
    """One row per file: ``file_path, header`` (its first line), ``is_closed``."""
    heads = lines.files.select(F.col("head").alias("pos"), "is_closed")
    return lines.rows.join(heads, "pos").select("file_path", F.col("value").alias("header"), "is_closed")


def _records(lines: Lines) -> DataFrame:
    """Data records of the closed files: ``file_path, block, pos, record``."""
    names = ["file_path", "block", "pos", "record"]
    open_splits = lines.splits.where("is_open").select("file_path", "block", "starts_inside", "opened")
    n = open_splits.count()
    if not n:
        found = lines.rows.withColumnRenamed("value", "record")
    else:
        # A split is bounded, so no key is hot where the list is too long to broadcast.
        listed = F.broadcast(open_splits) if n <= SPLITS_AT_ONCE else open_splits
        plain = lines.rows.join(listed, ["file_path", "block"], "left_anti").withColumnRenamed("value", "record")
        found = plain.select(names).unionByName(_stitched(lines.rows.join(listed, ["file_path", "block"])))
    # Places are unique, so this join has no hot key either.
    return found.join(lines.files.select(F.col("head").alias("pos")), "pos", "left_anti").where(
        F.trim("record") != ""
    ).select(names)


def _stitched(lines: DataFrame) -> DataFrame:
    """Records of splits with quoted line ends: a record belongs to the line that begins it."""
    in_split = W.partitionBy("file_path", "block").orderBy("pos")
    lines = _with_effects(lines.withColumnRenamed("value", "text"), in_split)
    state = F.when(F.col("is_fixed"), F.col("value")).otherwise(F.col("starts_inside") != F.col("value"))
    marked = lines.withColumn("after", state).withColumn(
        "before", F.coalesce(F.lag("after").over(in_split), F.col("starts_inside"))
    )
    here = F.when(~F.col("before"), F.struct("block", "pos"))
    owner = F.coalesce(F.last(here, ignorenulls=True).over(in_split), F.col("opened"))
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("block", "pos", "text"))), lambda l: l["text"]), "\n"
    )
    return (
        marked.withColumn("owner", owner)
        .groupBy("file_path", "owner")
        .agg(text.alias("record"))
        .select("file_path", "owner.block", "owner.pos", "record")
    )


def _cells(lines: Lines, width: int) -> DataFrame:
    names = [f"c{i}" for i in range(width)]
    ddl = ", ".join(f"{n} string" for n in names)
    return (
        _records(lines)
        .withColumn("row", F.from_csv("record", ddl, CSV_OPTIONS))
        .select("file_path", "block", "pos", F.array(*[F.col(f"row.{n}") for n in names]).alias("cells"))
    )


def csv_cells(spark: SparkSession, paths, width: int) -> DataFrame:
    """Data rows of headed CSV files: ``file_path, block, pos, cells``.

    ``cells`` is an array of ``width`` texts by position; ``(block, pos)`` orders
    the rows of one file. A file that cannot be read whole is an error.
    """
    lines = read_lines(spark, paths)
    unclosed = [r["file_path"] for r in lines.files.where("NOT is_closed").limit(5).collect()]
    if unclosed:
        raise ValueError(f"files end inside a quoted cell: {unclosed}")
    return _cells(lines, width)


def header_names(header: Column) -> Column:
    """The names of a header line: BOM and quotes dropped, trimmed, blanks as ``_``."""
    parts = F.split(F.regexp_replace(header, r"^\ufeff|\r\z", ""), OUTSIDE_QUOTES_COMMA)
    return F.transform(
        parts, lambda p: F.regexp_replace(strip(F.replace(p, F.lit('"'), F.lit(""))), r"\s+", "_")
    )


def named_cells(lines: Lines, heads: DataFrame, wanted: list[str]) -> DataFrame:
    """``file_path`` and the wanted columns by name, for the files in ``heads`` (file_path, names).

    Each file may order its columns in its own way: its order is a row of a small settled table that the records
    meet by file, in one scan however many files and orders there are. A column the file lacks is NULL.
    """
    places = F.transform(
        F.array(*[F.lit(n) for n in wanted]), lambda n: F.array_position("names", n).cast("int")
    )
    orders = settle(heads.select("file_path", places.alias("places")))
    width = orders.agg(F.max(F.array_max("places"))).first()[0] or 1
    rows = _cells(lines, width).join(orders, "file_path")
    place = [F.get("places", F.lit(i)) for i in range(len(wanted))]
    return rows.select("file_path", *[F.when(p > 0, F.get("cells", p - 1)).alias(n) for p, n in zip(place, wanted)])
