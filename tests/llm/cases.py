"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Columns whose names the operators use inside.
CLASHING = "key digest salt content hash hashes pos rows n tokens kept group_size text_key lines queue part before ids base spans label"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{name} string" for name in CLASHING.split()
)

Row = tuple[int | None, str | None]


def docs_of(spark: SparkSession, rows: list[Row], parts: int = 3) -> DataFrame:
    """Documents with clashing columns; lang, source and length are null now and then."""
    extra = len(CLASHING.split())
    data = [
        (i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 3}", len(t or "") if k % 4 else None, *["x"] * extra)
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def words_of(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(seed: int = 0) -> list[Row]:
    """Nulls, empty and very long texts, copies, near copies, odd characters, repeated rows."""
    rng = random.Random(seed)
    rows: list[Row] = [(None, None), (None, "no id at all, but a text of several words"), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one")]
    rows += [(5, "One TWO three four"), (6, "one two three four"), (7, "É é Straße ΣΑΣ naïve ÀÀ\nline\r\n\x1c odd\u00a0space ΟΔΟΣ")]
    long = " ".join(words_of(rng, 30_000, 5000))
    rows += [(8, long), (9, long + " tail"), (10, "\n" * 500), (11, "a" * 50_000)]
    rows += [(12, "repeated row"), (12, "repeated row"), (13, "same id, other text"), (13, "same id, yet another text")]
    for i in range(20, 60):
        rows.append((i, " ".join(words_of(rng, rng.randrange(1, 120)))))
    for i in range(60, 90):
        base = rows[20 + i % 30][1].split()
        base[rng.randrange(len(base))] = "changed"
        rows.append((i, "\n".join([" ".join(base), "A line that  many share ", "x", ""])))
    for i in range(90, 110):
        rows.append((i, rows[25][1]))
    return rows


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
