"""Chat template with a grammar round trip.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Every conversation is rendered plain,
read back by a deterministic parser and compared with its source. Where the two
differ (control strings or odd role names inside the content) it is rendered
again with escapes and compared again: inside texts each control string gets one
more backslash after its ``<``, which the parser takes away again, and a role is
percent-encoded. Built-in functions only.

Defined results: turns stand in the order of (turn, role, text), nulls first; null
roles and texts are empty; repeated rows are repeated turns; rows without conv_id are
one conversation. ``identical`` says that the parser recovered the source. An empty
table gives an empty result; other columns are ignored. A conversation becomes one
row, as its formatted text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|im_(start|end)\|>", r"<\\$1|im_$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|im_(start|end)\|>", r"<$1|im_$2|>")


def render(turns: Column, escaped: bool) -> Column:
    def turn(t: Column) -> Column:
        role, text = (F.url_encode(t["role"]), escape(t["text"])) if escaped else (t["role"], t["text"])
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))

    return F.array_join(F.transform(turns, turn), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text; a part that breaks the grammar becomes a null turn."""

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(head) + 2)
        text = F.substr(body, F.lit(1), F.length(body) - len(END))
        sound = F.endswith(part, F.lit("\n" + END)) | (
            F.endswith(body, F.lit(END)) & F.contains(part, F.lit("\n"))
        )
        sound = sound & ~F.contains(text, F.lit(END[:-1]))
        return F.when(sound, F.struct(F.try_url_decode(head).alias("role"), unescape(text).alias("text")))

    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), turn)


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (as read back), escaped, identical."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = (
        rows.select("conv_id", F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("sorted"))
        .select("conv_id", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    )
    plain = turns.withColumn("plain", render(F.col("source"), False))
    plain = plain.withColumn("escaped", ~parse(F.col("plain")).eqNullSafe(F.col("source")))
    chosen = plain.withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("plain"))
    )
    read = chosen.withColumn("turns", parse(F.col("formatted")))
    return read.select(
        "conv_id", "formatted", "turns", "escaped", F.col("turns").eqNullSafe(F.col("source")).alias("identical")
    )


def assistant_text(turns: Column) -> Column:
    """What the loss mask covers: each assistant text once, in order, nothing between."""
    spoken = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.array_join(F.transform(spoken, lambda t: t["text"]), "")


def turns_text(turns: Column) -> Column:
    each = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return F.array_join(each, "")
