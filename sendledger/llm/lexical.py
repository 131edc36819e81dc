"""Ranked lexical search by presence masks.

Every document is read once for its terms that some item asks for (term numbers and counts), its
number of terms, and the documents each term stands in. A second pass over these short rows ranks:
a block of documents holds one bitmap per term, the bitmaps of an item's terms put side by side give
each document's presence mask, and documents of one mask form a group. The most that a mask can score
is the sum of its terms' best contributions in the block; masks are evaluated from the highest down
until that most is below the item's k-th best score so far, so no better document can be left. A
task carries its best k per item from block to block; the few rows of each task meet in two steps.

The items' terms are shipped to the tasks in groups of about half of ``max_terms`` distinct (item, term)
pairs, counted before they are collected; each group reads the documents anew. An item's
own terms stay together.

Parameters: ``k`` documents an item, ``max_terms`` (200,000, about 30 MB in a worker).

Defined results: null and empty texts have no term; such documents count nowhere and such items get no
row. A document without ``doc_id`` counts and is ranked behind equal scores. Repeated rows
of a document are documents of their own; repeated rows of an item are answered each. Ties go to the smaller
doc_id. Empty tables give no rows. Other columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sendledger.llm.common import pieces, stored
from sendledger.llm.decontaminate import words

TOP = 20
MAX_TERMS = 200_000
_BLOCK = 2048  # documents whose bitmaps are held at once
_FIRST = 64  # documents evaluated before the first look at the bound
_LAST_ID = np.iinfo(np.int64).max
_TASKS = 256  # whose best rows meet in one group of the first step


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times): the distinct terms of each row of ``items``, ``item`` being the row's number."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            found = [Counter(words(t)) for t in batch.column("text").to_pylist()]
            own = np.repeat(np.arange(len(found)), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array((part << 40) + row + own), batch.column("item_id").take(pa.array(own)),
                 pa.array([w for c in found for w in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int64())],
                ["item", "item_id", "term", "times"],
            )
            row += batch.num_rows

    return items.select("item_id", "text").mapInArrow(run, f"item long, item_id {kind}, term binary, times long")


def document_terms(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, n, numbers, counts): the terms of each document that has any, those of ``asked`` (term, number) by number.

    ``numbers`` and ``counts`` are packed int32 and int64.
    """
    shared = docs.sparkSession.sparkContext.broadcast({bytes(r.term): r.number for r in asked.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches):
            kept, n, numbers, counts = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = words(text)
                if found:
                    own = Counter(map(known.get, found))
                    own.pop(None, None)
                    kept.append(i)
                    n.append(len(found))
                    numbers.append(np.fromiter(own.keys(), np.int32, len(own)).tobytes())
                    counts.append(np.fromiter(own.values(), np.int64, len(own)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()),
                 pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "n", "numbers", "counts"],
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n long, numbers binary, counts binary")


def _held(rows: DataFrame) -> DataFrame:
    """(number, df): in how many documents each asked term stands, summed inside each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in pieces(batches, 20_000):
            found, times = np.unique(np.frombuffer(b"".join(batch.column("numbers").to_pylist()), np.int32), return_counts=True)
            total.update(dict(zip(found.tolist(), times.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["number", "df"])

    return rows.select("numbers").mapInArrow(run, "number int, df long").groupBy("number").agg(F.sum("df").alias("df"))


class Queries:
    """Items with their term numbers and weights (the weight of a term times its repeats in the item)."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], docs: int, terms: int, k: int):
        self.items, self.docs, self.terms, self.k = items, docs, terms, k


class Block:
    """Some documents: a bitmap per term, and what each term adds to each document that holds it, before weights."""

    def __init__(self, rows: pa.RecordBatch, queries: Queries):
        ids = rows.column("doc_id")
        self.ids, self.null = ids.fill_null(_LAST_ID).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        packed = rows.column("numbers").to_pylist()
        sizes = np.array([len(b) // 4 for b in packed], np.int64)
        self.ends = np.concatenate(([0], np.cumsum(sizes)))
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int64)
        long = 75 + 25 * rows.column("n").to_numpy() * queries.docs // queries.terms  # a document's length measure
        row = np.repeat(np.arange(len(self.ids)), sizes)
        self.adds = 1_000_000_000 * counts // (1000 * counts + 12 * long[row])
        self.terms, self.local = np.unique(np.frombuffer(b"".join(packed), np.int32), return_inverse=True)
        self.best = np.zeros(len(self.terms) + 1, np.int64)  # the last stands for terms that no document has
        np.maximum.at(self.best, self.local, self.adds)
        held = np.zeros((len(self.terms) + 1, len(self.ids)), bool)
        held[self.local, row] = True
        self.bitmaps = np.packbits(held, axis=1)

    def rank(self, numbers: np.ndarray, weights: np.ndarray, best: tuple, k: int) -> tuple:
        """The best k of ``best`` (scores, ids, nulls) and this block's documents, for one item."""
        at = np.searchsorted(self.terms, numbers)
        at[np.append(self.terms, -1)[at] != numbers] = len(self.terms)
        own = at < len(self.terms)
        at, weights = at[own], weights[own]
        floor = best[0][k - 1] if len(best[0]) == k else 1  # a score of 0 never counts
        if not len(at) or (self.best[at] * weights).sum() < floor:
            return best
        bits = np.unpackbits(self.bitmaps[at], axis=1, count=len(self.ids)).T
        group, masks = _grouped(bits)
        most = masks @ (self.best[at] * weights)
        members = np.argsort(-most[group], kind="stable")  # documents, by the most that their mask can score
        bound = most[group][members]
        weight_of = np.zeros(len(self.terms), np.int64)
        weight_of[at] = weights
        first, step = 0, _FIRST
        while first < len(members) and bound[first] >= floor:
            chosen = members[first : first + step]
            best = _best(best, self._scores(chosen, weight_of), self.ids[chosen], self.null[chosen], k)
            floor = best[0][k - 1] if len(best[0]) == k else 1
            first, step = first + step, 2 * step
        return best

    def _scores(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        begin, sizes = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        run = np.concatenate(([0], np.cumsum(self.adds[at] * weight_of[self.local[at]])))
        stop = np.cumsum(sizes)
        return run[stop] - run[stop - sizes]


def _grouped(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row of a 0/1 matrix, and one row of each group: 64 columns at a time, renumbered."""
    packed = np.packbits(bits, axis=1)
    packed = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)
    group = np.zeros(len(bits), np.int64)
    for column in packed.T:
        _, value = np.unique(column, return_inverse=True)
        _, first, group = np.unique(group * len(bits) + value, return_index=True, return_inverse=True)
    return group, bits[first].astype(np.int64)


def _best(best: tuple, scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> tuple:
    some = scores > 0
    scores, ids, null = (np.concatenate((a, b[some])) for a, b in zip(best, (scores, ids, null)))
    order = np.lexsort((null, ids, -scores))[:k]
    return scores[order], ids[order], null[order]


def _ranked(rows: DataFrame, shared) -> DataFrame:
    """(part, item, doc_id, score): each task's best k of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        best = [none] * len(queries.items)
        for batch in pieces(batches, _BLOCK):
            if batch.num_rows:
                block = Block(batch, queries)
                for i, (_, numbers, weights) in enumerate(queries.items):
                    best[i] = block.rank(numbers, weights, best[i], queries.k)
        part = TaskContext.get().partitionId()
        for (item, _, _), (scores, ids, null) in zip(queries.items, best):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(np.full(len(ids), item)), pa.array(ids, mask=null), pa.array(scores)],
                    ["part", "item", "doc_id", "score"],
                )

    return rows.mapInArrow(run, "part int, item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, max_terms: int = MAX_TERMS) -> DataFrame:
    """The ``k`` best documents of each row of ``items``: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = stored(item_terms(items))
    pairs = asked.count()
    groups = max(1, math.ceil(2 * pairs / max_terms))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(groups)))
    parts = []
    for chunk in range(groups):
        own = asked if groups == 1 else asked.where(F.col("chunk") == chunk)
        # a group holds about max_terms / 2 pairs
        vocabulary = stored(own.select("term").distinct().withColumn(
            "number", (F.row_number().over(Window.orderBy("term")) - 1).cast("int")
        ))
        rows = stored(document_terms(docs, vocabulary))
        total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            continue
        odds = (2 * F.lit(total.docs) + 2) / (2 * F.coalesce("df", F.lit(0)) + 1)
        weight = F.floor(1000 * F.log(odds.cast("double"))).cast("long")
        weighed = vocabulary.join(_held(rows), "number", "left").select("term", "number", weight.alias("weight"))
        wanted: dict[int, list] = {}
        for r in own.join(weighed, "term").select("item", "number", (F.col("weight") * F.col("times")).alias("weight")).collect():
            wanted.setdefault(r.item, []).append((r.number, r.weight))
        queries = [(item, *(np.array(c, np.int64) for c in zip(*sorted(found)))) for item, found in wanted.items()]
        shared = spark.sparkContext.broadcast(Queries(queries, total.docs, total.terms, k))
        parts.append(_ranked(rows, shared))
    if not parts:
        empty = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
        return spark.createDataFrame([], empty)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item", "some").orderBy(*order)
    found = found.withColumn("some", F.expr(f"part div {_TASKS}"))
    found = found.withColumn("place", F.row_number().over(some)).where(F.col("place") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = asked.select("item", "item_id").distinct()
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
