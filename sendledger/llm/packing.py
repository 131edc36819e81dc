"""Packing with a controlled mixture: deficit round-robin over the source queues.

Each source is a queue of tokens, its documents in storage order. In round r queue
s has been served floor(r * q_s) tokens, q_s being its share of a window: what
rounding leaves over is the deficit that the queue carries into later windows. The
rounds, one after another, form one stream without gaps, cut every ``window`` tokens
into sequences; a queue that runs dry is skipped and the others keep their ratio.
Since served totals have a closed form, every task places its own pieces: a token's
place follows from its index in its queue. That index is the sum of the earlier
partitions (a small table) plus a running sum inside the partition, so no task
reads a whole queue.

A piece's place looks at every queue's numbers once for each round that a batch meets, so the work
grows with rounds times queues, not with tokens times queues.

Without ``weights`` the target is each source's share of all tokens. Every source has a queue
of its own, however many there are; the tasks hold the queues' names and numbers (about 100 bytes each).
Only if ``max_queues`` is given, a source beyond the largest shares a queue with others, chosen by hash,
which has their weights added up.

Defined results: a null or empty text is the end token alone; a null source is a
source of its own with a null queue; repeated rows are packed as often as they occur; a null doc_id is
kept. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sendledger.llm.common import pieces, stored

WINDOW = 2048
END_ID = 1
_FRACTION = 16  # bits of a share after the point
_MEMO_WORDS = 200_000  # words whose ids a task remembers, about 40 MB
_KEPT_WORDS = 100_000  # a worker goes on to other tasks with at most so many
_SLICE = 8_000_000  # bytes of text encoded at once
_WHOLE = "<\\||[\u0300-\u036f]"  # texts that are not cut into words
_MARK = "\x02"  # stands between words that are encoded together
_LOWERED = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 10 else c for c in range(256))
_CELLS = 2_000_000  # (round, queue) pairs looked at together
_PLACES_LIMIT = 200_000  # rows of the start table that may be broadcast, about 8 MB


class _Encoder:
    """Ids of many texts at once, by the distinct words between spaces and line ends.

    White space always parts words, so a text's ids are its words' ids one after another. A-Z
    is lower-cased beforehand, as the tokenizer does after composing. Texts that may hold a special
    token's string, or marks that compose with A-Z, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 2**16:
            raise ValueError("ids must fit 16 bits")
        self.mark = self._whole(_MARK)[0]
        self.ends = np.zeros(2**16, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.signs = {c: self._whole(c).tobytes() for c in ".,;:!?"}
        self.memo: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _encode_lines(self, found: list[str], between: str) -> Iterator[tuple[list[str], np.ndarray]]:
        lines = [found[i : i + 200] for i in range(0, len(found), 200)]
        texts = [between.join(line) for line in lines]
        for line, encoded in zip(lines, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            yield line, np.array(encoded.ids, np.uint16)

    def _remember(self, line: list[str], ids: np.ndarray, starts: list[int], stops: list[int]) -> None:
        data = ids.tobytes()
        self.memo.update((w, data[2 * i : 2 * j]) for w, i, j in zip(line, starts, stops))

    def _learn(self, found: list[str]) -> None:
        """Encode words together. A word of letters is as a rule one piece, whose last id ends a word."""
        plain = {w for w in found if w.isalpha() and self._stays(w)}
        marked = [w for w in found if w not in plain and _MARK not in w]
        for line, ids in self._encode_lines([w for w in found if w in plain], " "):
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(line):
                self._remember(line, ids, [0, *stops[:-1]], stops)
            else:
                marked += line
        for line, ids in self._encode_lines(marked, f" {_MARK} "):
            marks = np.flatnonzero(ids == self.mark)
            self._remember(line, ids, [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)])
        self.memo.update((w, self._whole(w).tobytes()) for w in found if _MARK in w)

    @staticmethod
    def _stays(stem: str) -> bool:
        """Whether the tokenizer sees letters alone in these letters, so that a sign behind them stands apart.

        Composing and lower-casing may leave a mark at the end (as of a dotted capital I), which would join the sign.
        """
        return stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha()

    def _words(self, names: list[str]) -> list[bytes]:
        """The ids of distinct words; letters with one sign at their end share the letters' ids."""
        values = list(map(self.memo.get, names))
        if len(self.memo) > _MEMO_WORDS:  # go on with the words of this slice
            self.memo = {w: v for w, v in zip(names, values) if v is not None}
        memo, signs = self.memo, self.signs
        rest = [i for i, v in enumerate(values) if v is None]
        stems = [
            w[:-1] if w[-1:] in signs and w[:-1].isalpha() and self._stays(w[:-1]) else w
            for w in map(names.__getitem__, rest)
        ]
        missing = {w for w in stems if w not in memo}
        if missing:
            self._learn(list(missing))
        for i, stem in zip(rest, stems):
            own = memo[stem]
            values[i] = own if len(stem) == len(names[i]) else own + signs[names[i][-1]]
        return values

    def _plain(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after another, and the number of each."""
        _, offsets, data = texts.buffers()
        lowered = pa.py_buffer(data.to_pybytes().translate(_LOWERED) if data else b"")
        texts = pa.StringArray.from_buffers(len(texts), offsets, lowered, offset=texts.offset)
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        names, use = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        values = self._words(names)
        # a slice has far fewer than 2^31 ids
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // 2
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        counts = sizes[use]
        ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int32)), dtype=np.int32)
        at = np.repeat(starts[use] - ends[:-1], counts)
        at += np.arange(ends[-1], dtype=np.int32)
        edges = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return np.frombuffer(b"".join(values), np.uint16)[at], np.diff(edges)

    def encode(self, texts: pa.StringArray) -> Iterator[list[np.ndarray]]:
        """Ids of each text, some texts at a time; null is empty."""
        texts = texts.fill_null("")
        special = pc.match_substring_regex(texts, _WHOLE).to_pylist()
        size, first = 0, 0
        for i, length in enumerate([*pc.binary_length(texts).to_pylist(), None]):
            if i > first and (length is None or size + length > _SLICE):
                ids, counts = self._plain(pa.concat_arrays([texts.slice(first, i - first)]))
                out = np.split(ids, np.cumsum(counts)[:-1])
                for k in (k for k in range(first, i) if special[k]):
                    out[k - first] = self._whole(texts[k].as_py())
                yield out
                size, first = 0, i
            size += length or 0


_ENCODERS: dict[str, _Encoder] = {}


def tokenized(docs: DataFrame, tokenizer_path: str | None) -> DataFrame:
    """(doc_id, queue, part, before, doc_tokens, ids): ids as little-endian uint16, the end id included.

    ``before`` counts the queue's tokens earlier in the same partition ``part``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        if path not in _ENCODERS:
            _ENCODERS[path] = _Encoder(path)
        encoder, served = _ENCODERS[path], {}
        part, end = TaskContext.get().partitionId(), np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            at = 0
            for some in encoder.encode(batch.column("text")):
                part_of = batch.slice(at, len(some))
                before, count = [], [len(own) + 1 for own in some]
                for n, queue in zip(count, part_of.column("queue").to_pylist()):
                    before.append(served.get(queue, 0))
                    served[queue] = served.get(queue, 0) + n
                yield pa.RecordBatch.from_arrays(
                    [part_of.column("doc_id"), part_of.column("queue"), pa.array([part] * len(some), pa.int32()),
                     pa.array(before, pa.int64()), pa.array(count, pa.int64()),
                     pa.array([own.tobytes() + end for own in some], pa.binary())],
                    ["doc_id", "queue", "part", "before", "doc_tokens", "ids"],
                )
                at += len(some)
        if len(encoder.memo) > _KEPT_WORDS:
            encoder.memo.clear()

    return docs.select("doc_id", "queue", "text").mapInArrow(
        run, f"doc_id {kind}, queue string, part int, before long, doc_tokens long, ids binary"
    )


def _queued(docs: DataFrame, max_queues: int | None) -> Callable[[DataFrame], DataFrame]:
    """Adds ``queue`` to rows with ``source``: empty for null, else a sign and the source's or the shared name."""
    own = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    if max_queues is None:
        return lambda rows: rows.withColumn("queue", own)
    sizes = docs.groupBy("source").agg(F.sum(F.length("text")).alias("size"))
    if sizes.limit(max_queues + 1).count() <= max_queues:
        return lambda rows: rows.withColumn("queue", own)
    largest = stored(sizes.orderBy(F.desc("size"), "source").limit(max_queues // 2).select(
        F.col("source").alias("large"), F.lit(True).alias("is_large")
    ))
    shared = F.concat(F.lit("+shared "), F.pmod(F.xxhash64("source"), F.lit(max_queues // 2)))

    def merged(rows: DataFrame) -> DataFrame:
        marked = rows.join(F.broadcast(largest), F.col("source").eqNullSafe(F.col("large")), "left")
        return marked.withColumn("queue", F.when(F.col("is_large"), own).otherwise(shared))

    return merged


def _named(pieces: DataFrame) -> DataFrame:
    """``queue`` without its sign."""
    return pieces.withColumn("queue", F.when(F.col("queue") != "", F.substring("queue", 2, 2**31 - 1)))


class Rounds:
    """The round-robin of the queues in closed form: three numbers a queue, whatever they hold."""

    def __init__(self, totals: dict[str, int], window: int, weights: dict[str, float] | None):
        self.window, self.names = window, sorted(totals)
        self.totals = np.array([totals[n] for n in self.names], np.int64)
        shares = np.array([(weights or totals).get(n, 0) for n in self.names], float)
        shares = shares / shares.sum() if shares.sum() else np.ones(len(shares)) / max(1, len(shares))
        self.quanta = np.maximum(1, np.round(shares * window * 2**_FRACTION)).astype(np.int64)
        self.last = -((-self.totals << _FRACTION) // self.quanta)  # the round in which a queue runs dry

    def served(self, queue: int, rounds: np.ndarray) -> np.ndarray:
        """Tokens that a queue has given by the end of these rounds."""
        capped = np.minimum(rounds, self.last[queue]) * self.quanta[queue] >> _FRACTION
        return np.minimum(self.totals[queue], capped)

    def _others(self, queue: int, rounds: np.ndarray) -> np.ndarray:
        """Tokens of all other queues that stand before this queue's turn in these rounds."""
        distinct, which = np.unique(rounds, return_inverse=True)
        before = (np.arange(len(self.names)) >= queue).astype(np.int64)  # a later queue has had its turn in the last round
        own = np.arange(len(self.names)) != queue
        found, step = np.empty(len(distinct), np.int64), max(1, _CELLS // len(self.names))
        for i in range(0, len(distinct), step):
            ended = distinct[i : i + step, None] - before
            served = np.minimum(self.totals, np.minimum(ended, self.last) * self.quanta >> _FRACTION)
            found[i : i + step] = served[:, own].sum(axis=1)
        return found[which]

    def place(self, queue: int, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the documents at tokens first..first+count of a queue stand.

        Gives for each piece, in order: its document's index, its first token, its length and its
        position in the stream.
        """
        quantum, stop = int(self.quanta[queue]), first + count
        if quantum >= 1 << _FRACTION:  # some tokens in every round
            low, high = (-((-(t << _FRACTION)) // quantum) for t in (first + 1, stop))
            number = high - low + 1
            doc = np.repeat(np.arange(len(first)), number)
            rounds = np.arange(len(doc)) + np.repeat(low - (np.cumsum(number) - number), number)
        else:  # at most one token in a round
            doc = np.repeat(np.arange(len(first)), count)
            tokens = np.arange(len(doc)) + np.repeat(first - (np.cumsum(count) - count), count)
            rounds = -((-((tokens + 1) << _FRACTION)) // quantum)
        begins = np.maximum(self.served(queue, rounds - 1), first[doc])
        lengths = np.minimum(self.served(queue, rounds), stop[doc]) - begins
        filled = lengths > 0
        doc, rounds, begins, lengths = doc[filled], rounds[filled], begins[filled], lengths[filled]
        at = begins + self._others(queue, rounds)
        # a run holds at most one window of tokens, so it crosses at most one border
        head = np.minimum(lengths, self.window - at % self.window)
        pieces = 1 + (head < lengths)
        second = np.zeros(pieces.sum(), bool)
        second[np.cumsum(pieces)[pieces == 2] - 1] = True
        doc, begins, lengths, at, head = (np.repeat(x, pieces) for x in (doc, begins, lengths, at, head))
        shift = np.where(second, head, 0)
        return doc, begins + shift - first[doc], np.where(second, lengths - head, head), at + shift


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    window: int = WINDOW,
    weights: dict[str, float] | None = None,
    max_queues: int | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source queue."""
    docs = docs.select("doc_id", "source", "text")
    queued = _queued(docs, max_queues)
    tokens = stored(tokenized(queued(docs), tokenizer_path))
    parts = tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("tokens"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = stored(parts.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))))
    totals = places.groupBy("queue").agg(F.sum("tokens").alias("total"))
    if weights:
        given = docs.sparkSession.createDataFrame([(n, float(w)) for n, w in weights.items()], "source string, weight double")
        given = queued(given.withColumn("source", F.col("source").cast(docs.schema["source"].dataType)))
        totals = totals.join(given.groupBy("queue").agg(F.sum("weight").alias("weight")), "queue", "left")
    else:
        totals = totals.withColumn("weight", F.col("total").cast("double"))
    totals = stored(totals.fillna(0.0, ["weight"]))
    queues = totals.collect()  # one row per source
    rounds = Rounds({r.queue: r.total for r in queues}, window, {r.queue: r.weight for r in queues})
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((rounds, {name: i for i, name in enumerate(rounds.names)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, number = shared.value
        for batch in pieces(batches, 2000):
            base, before, count = (batch.column(c).to_numpy() for c in ("base", "before", "doc_tokens"))
            queue = np.array([number[q] for q in batch.column("queue").to_pylist()])
            found = []
            for q in np.unique(queue):
                own = np.flatnonzero(queue == q)
                doc, *rest = rounds.place(int(q), (base + before)[own], count[own])
                found.append((own[doc], *rest))
            doc, start, length, at = (np.concatenate(x) for x in zip(*found))
            wide = memoryview(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u2").astype("<u4").tobytes())
            first = 4 * ((np.cumsum(count) - count)[doc] + start)
            checks = [zlib.crc32(wide[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), pa.array(start), pa.array(length), pa.array(checks, pa.int64()),
                 batch.column("doc_tokens").take(take), pa.array(at // window), pa.array(at % window),
                 batch.column("queue").take(take)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

    base = places.select("queue", "part", "base")
    placed = tokens.join(F.broadcast(base) if base.count() <= _PLACES_LIMIT else base, ["queue", "part"])
    return _named(placed.select("doc_id", "queue", "base", "before", "doc_tokens", "ids").mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, queue string",
    ))
