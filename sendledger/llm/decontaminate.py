"""Benchmark passages in training text: a broadcast hash set of test n-grams, scanned and verified.

Windows of ``width`` words of the benchmark form the set. A document's words are
numbered by the set's vocabulary; only where ``width`` known words stand in a row is
a rolling hash looked up, and every hit is compared word by word. Words inside
any hit are marked. The set's size is counted before it is broadcast; a larger
benchmark is scanned in blocks of at most ``max_windows`` windows, whose hits are
then merged per text.

Defined results: a null or wordless text has no words and is never contaminated; a
benchmark item without words has no window, one with fewer than ``width`` words is
one window. Items without ``item_id`` mark words but are not listed. Repeated
documents are judged alike, repeated items count once. Empty tables give an empty
result or no hits. Other columns are ignored by ``contamination`` and carried
along by ``clean_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sendledger.llm.common import pieces, text_key

WIDTH = 13
MAX_WINDOWS = 200_000  # about 60 MB in a worker
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def _hashes(numbers: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for j in range(width):
        h = (h + numbers[starts + j].astype(np.uint64)) * _STEP
        h ^= h >> np.uint64(29)
    return h


class WindowSet:
    """The windows of some benchmark items, ready to scan documents."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
        for item, found in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
            size = min(width, len(numbers))
            for i in range(len(numbers) - size + 1 if size else 0):
                self.owners.setdefault(size, {}).setdefault(tuple(numbers[i : i + size]), set()).add(item)
        self.known = {}
        for size, windows in self.owners.items():
            flat = np.array(list(windows), np.int64).reshape(-1)
            self.known[size] = np.unique(_hashes(flat, np.arange(0, len(flat), size), size))

    def scan(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Positions of the words hit, and the items whose windows occur."""
        number = self.vocabulary.get
        numbers = np.array([number(w, 0) for w in found], np.int64)
        run = np.concatenate(([0], np.cumsum(numbers > 0)))
        edges, items = np.zeros(len(found) + 1, np.int64), set()
        for size, known in self.known.items():
            starts = np.flatnonzero(run[size:] - run[:-size] == size) if len(found) >= size else ()
            if not len(starts):
                continue
            hashes = _hashes(numbers, starts, size)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for i in starts[known[at] == hashes].tolist():
                owners = self.owners[size].get(tuple(numbers[i : i + size].tolist()))
                if owners:
                    items |= owners
                    edges[i] += 1
                    edges[i + size] -= 1
        return np.flatnonzero(np.cumsum(edges[:-1])), items - {None}


def _blocks(benchmark: DataFrame, width: int, max_windows: int) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of at most ``max_windows`` words.

    A longer item is cut into runs that share ``width`` - 1 words, so that each of its windows lies in one of them.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    most = max(max_windows, 2 * width)
    block, size = [], 0
    for row in items.toLocalIterator():  # one partition at a time, one block in memory
        found = words(row.text)
        for first in range(0, max(1, len(found) - width + 1), most - width + 1):
            run = found[first : first + most]
            if block and size + len(run) > max_windows:
                yield block
                block, size = [], 0
            if run:
                block.append((row.item, run))
                size += len(run)
    yield block


def _scanner(shared, width: int, extra: str):
    """A mapInArrow function over (*kept columns, text): words, hit positions and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in pieces(batches):
            n, hits, items = [], [], []
            for text in batch.column("text").to_pylist():
                found = words(text)
                places, owners = windows.scan(found)
                n.append(len(found))
                hits.append(places.astype(np.int32))
                items.append(sorted(owners))
            yield pa.RecordBatch.from_arrays(
                [batch.column(extra), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.string()))],
                [extra, "n_words", "hits", "items"],
            )

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, hits (word positions), items (ids as text)."""
    spark = docs.sparkSession
    schema = "n_words long, hits array<int>, items array<string>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(benchmark, width, max_windows)
    first, second = next(blocks), next(blocks, None)
    shared = spark.sparkContext.broadcast(WindowSet(first, width))
    if second is None:
        rows = docs.select("doc_id", "text")
        return rows.mapInArrow(_scanner(shared, width, "doc_id"), f"doc_id {kind}, {schema}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text_key(text).alias("text_key"))
    texts, parts = rows.select("text_key", "text"), []
    while True:
        parts.append(texts.mapInArrow(_scanner(shared, width, "text_key"), f"text_key binary, {schema}"))
        if second is None:
            break
        shared, second = spark.sparkContext.broadcast(WindowSet(second, width)), next(blocks, None)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part.where(F.size("hits") > 0))
    merged = every.groupBy("text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return rows.select("doc_id", "text_key").join(merged, "text_key").drop("text_key")


def is_contaminated(n_hit: F.Column, n_words: F.Column):
    """A twentieth of the words at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _judged_texts(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """Hits of each distinct text that has any, by text key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(text_key(text).alias("doc_id"), "text")
    return contamination(keyed, benchmark, width).where(F.size("hits") > 0).dropDuplicates(["doc_id"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, all columns kept."""
    blocks = _blocks(benchmark, width, MAX_WINDOWS)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet(first, width))

        def run(batches):
            for batch in pieces(batches):
                clean = []
                for text in batch.column("text").to_pylist():
                    found = words(text)
                    hit = len(shared.value.scan(found)[0])
                    clean.append(not (hit and 20 * hit >= len(found)))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    judged = _judged_texts(docs, benchmark, width).withColumnRenamed("doc_id", "key")
    bad = judged.where(is_contaminated(F.size("hits"), F.col("n_words"))).select("key")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(text).alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")


def without_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text): the words hit are cut out of each text, with what stands between them."""
    hits = _judged_texts(docs, benchmark, width).select(F.col("doc_id").alias("key"), "hits")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "text", text_key(text).alias("key")).join(hits, "key", "left").drop("key")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            texts = []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                if hits:
                    spans = [m.span() for m in _WORD.finditer(text)]
                    kept, at = [], 0
                    for group in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1):
                        kept.append(text[at : spans[group[0]][0]])
                        at = spans[group[-1]][1]
                    text = "".join(kept) + text[at:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")
