"""Phrases whose words stand together: an index of word numbers per shard, counts summed over shards.

A shard is some megabytes of texts of one language, as word numbers with a separator where a piece
ends. Its index is a Burrows-Wheeler transform of the word numbers and one of their reverse, sorted
by as many words as the longest phrase has. A phrase is an interval in both; counting the words
before (or behind) its places gives all its extensions by one word to the left (or right), with their
counts and both new intervals, so phrases are listed length by length and nothing is hashed or looked
up. Shard counts are summed by Spark.

Passes over the texts keep the listing short. The first counts words. The next one cuts
the texts at words that are too rare for any phrase and counts pairs. The one after it cuts them
also between words that are too rare a pair and counts phrases of three and four words, which a shard lists once each.
Longer phrases are counted by two lengths a pass, and only those grow whose triples are common. The common words, pairs
and triples are known by bitmaps of fixed size (``filter_bits``) over their hashes: a bitmap may
let rare ones through, which costs work but no row, as every count is checked. A phrase travels as the
64-bit hashes of its words; the words themselves join the common phrases at the end.

Parameters: ``min_count``, ``longest`` words, ``share`` percent, ``top`` phrases a language, ``filter_bits``
(2**26, three bitmaps of 8 MB in a worker).

Defined results: a null text is empty, a null language is ``und``. Texts without words add nothing. Repeated
rows count as often as they occur; doc_id is not read. Equal scores go by count, then by phrase in byte
order. Long texts are read whole, one text being at least one shard. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from sendledger.llm.common import BITMAP_ROW, bitmap, inside, stored

_SHARD = 6_000_000  # bytes of text of a shard
_WAITING = 24_000_000  # bytes of texts of all languages that wait for their shard to fill
FILTER_BITS = 2**26
_SALTS = 8  # parts of the counts of one phrase that many longer ones hold
_RANKS = 64  # groups of a language that are ranked before they meet
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256)
)


class Shard:
    """Word numbers of some texts, 0 between pieces; ``names`` holds the words, the separator first."""

    def __init__(self, lang: str, texts: list[str]):
        self.lang = lang
        raw = "\n".join(texts).encode().translate(_BYTES).replace(b"\n", b" \n ") + b" \n"
        coded = pc.split_pattern(pa.array([raw], pa.binary()).cast(pa.large_string()), " ").flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.large_binary()).to_pylist()
        number = np.zeros(len(names), np.int64)
        real = [i for i, w in enumerate(names) if w not in (b"", b"\n")]
        number[real] = np.arange(1, len(real) + 1)
        keep = np.array([w != b"" for w in names], bool)
        use = coded.indices.to_numpy()
        self.text = number[use[keep[use]]]
        self.names = [b""] + [names[i] for i in real]

    def hashes(self) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(self.lang.encode(), 42)
        return np.array([xxhash.xxh64_intdigest(w, seed) for w in self.names], np.uint64)


# The constants of xxHash64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return h << np.uint64(bits) | h >> np.uint64(64 - bits)


def phrase_hash(words: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` over the columns of a table of word hashes."""
    h = np.full(len(words), 42, np.uint64)
    for word in words.T:
        h = h + _P5 + np.uint64(8) ^ _turned(word * _P2, 31) * _P1
        h = _turned(h, 27) * _P1 + _P4
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        h ^= h >> np.uint64(32)
    return h


def cut(text: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The words that are linked to a neighbour, with a 0 behind each that is not linked to the next one.

    ``linked[i]`` says that words i and i + 1 may stand in one phrase.
    """
    if not len(text):
        return text
    linked = np.append(linked, False)
    kept = linked | np.concatenate(([False], linked[:-1]))
    ends = ~linked[kept]
    out = np.zeros(kept.sum() + ends.sum(), np.int64)
    out[np.arange(kept.sum()) + np.cumsum(ends) - ends] = text[kept]
    return out


class Transform:
    """The Burrows-Wheeler transform of a text that ends with 0, sorted by the first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        rank, width = text, 1
        while width < depth:
            rank = np.unique(rank * (int(rank.max()) + 1) + np.roll(rank, -width), return_inverse=True)[1]
            width *= 2
        self.symbols, self.size = symbols, len(text)
        self.last = text[np.argsort(rank, kind="stable") - 1]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        at = np.argsort(self.last, kind="stable")
        self.places = self.last[at] * self.size + at

    def before(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a place."""
        return np.searchsorted(self.places, symbol * self.size + place) - self.begin[symbol]

    def extended(self, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions by one symbol of phrases with intervals at ``low`` here and ``other`` in the reverse's transform.

        Gives the phrase and symbol of each, and its own low, other and size.
        """
        phrase = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(phrase)) + np.repeat(low - (np.cumsum(size) - size), size)
        found, times = np.unique(phrase * self.symbols + self.last[place], return_counts=True)
        phrase, symbol = found // self.symbols, found % self.symbols
        earlier = np.cumsum(times) - times
        smaller = earlier - earlier[np.searchsorted(phrase, phrase)]  # extensions of the same phrase
        word = symbol > 0
        phrase, symbol, smaller, times = phrase[word], symbol[word], smaller[word], times[word]
        return phrase, symbol, self.begin[symbol] + self.before(symbol, low[phrase]), other[phrase] + smaller, times


def phrases(
    text: np.ndarray, symbols: int, longest: int, common: Callable[[np.ndarray], np.ndarray] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The phrases of 2 to ``longest`` words of a text, as rows of word numbers with their counts, length by length.

    They grow to the right and to the left in turn. Given ``common``, which judges rows of three words, phrases
    with a triple that is not are left out.
    """
    if not len(text):
        return
    backward = Transform(np.roll(text[::-1], -1), symbols, longest)
    forward = Transform(text, symbols, longest) if longest > 2 else backward  # pairs grow to the right only
    size = np.bincount(text, minlength=symbols)
    words = np.flatnonzero(size[1:]) + 1
    low, mirror, size, rows = forward.begin[words], backward.begin[words], size[words], words[:, None]
    for length in range(2, longest + 1):
        if length % 2:
            phrase, symbol, low, mirror, size = forward.extended(low, mirror, size)
            rows = np.concatenate((symbol[:, None], rows[phrase]), axis=1)
        else:
            phrase, symbol, mirror, low, size = backward.extended(mirror, low, size)
            rows = np.concatenate((rows[phrase], symbol[:, None]), axis=1)
        if common and length > 2:  # the other triples were judged before
            kept = common(rows[:, :3] if length % 2 else rows[:, -3:])
            low, mirror, size, rows = low[kept], mirror[kept], size[kept], rows[kept]
        yield rows, size


def _over_shards(docs: DataFrame, each: Callable[[Shard], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, sizes = defaultdict(list), defaultdict(int)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                waiting[lang].append(text)
                sizes[lang] += len(text)
                if sizes[lang] >= _SHARD or sum(sizes.values()) >= _WAITING:
                    full = max(sizes, key=sizes.get)
                    yield from each(Shard(full, waiting.pop(full)))
                    del sizes[full]
        for lang in list(waiting):
            yield from each(Shard(lang, waiting.pop(lang)))

    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    return texts.mapInArrow(run, schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f): how often each word occurs; for the null phrase, all words together."""

    def each(shard: Shard) -> Iterator[pa.RecordBatch]:
        times = np.bincount(shard.text, minlength=len(shard.names))
        times[0] = times[1:].sum()
        words = pa.array([None, *shard.names[1:]], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(times)), words, pa.array(times)], ["lang", "phrase", "f"])

    return _over_shards(docs, each, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _common_words(shard: Shard, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard's text cut at rare words, and the hashes of its words."""
    hashes = shard.hashes()
    known = inside(common, hashes)
    known[0] = False
    holds = known[shard.text]
    return cut(shard.text, holds[:-1] & holds[1:]), hashes


def _common_pairs(shard: Shard, common: np.ndarray, paired: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard's text cut at rare words and between rare pairs, and the hashes of its words."""
    text, hashes = _common_words(shard, common)
    own = hashes[text]
    linked = (text[:-1] > 0) & (text[1:] > 0)
    linked &= inside(paired, phrase_hash(np.stack((own[:-1], own[1:]), axis=1)))
    return cut(text, linked), hashes


def _words(length: int) -> list[str]:
    return [f"w{i}" for i in range(1, length + 1)]


def passes(longest: int) -> list[range]:
    """The lengths of phrases that each pass over the texts counts: pairs, then two lengths at a time."""
    return [range(2, 3)] + [range(first, min(first + 1, longest) + 1) for first in range(3, longest + 1, 2)]


def phrase_counts(docs: DataFrame, known: tuple, min_count: int, lengths: range) -> DataFrame:
    """(w1, w2, .., f): the phrases of these lengths that occur often enough, by the hashes of their words.

    Shorter ones end with nulls. ``known`` holds the bitmaps of common words, for three words and more of pairs, and
    for five and more of triples.
    """

    def each(shard: Shard) -> Iterator[pa.RecordBatch]:
        maps = [k.value for k in known]
        text, hashes = (_common_words if lengths[0] == 2 else _common_pairs)(shard, *maps[:2])
        common = (lambda rows: inside(maps[2], phrase_hash(hashes[rows]))) if lengths[0] > 3 else None
        for rows, size in phrases(text, len(shard.names), lengths[-1], common):
            if rows.shape[1] in lengths:
                columns = [pa.array(hashes[w].view(np.int64)) for w in rows.T]
                columns += [pa.nulls(len(rows), pa.int64())] * (len(names) - len(columns))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(size)], [*names, "f"])

    names = _words(lengths[-1])
    counted = _over_shards(docs, each, ", ".join(f"{n} long" for n in [*names, "f"]))
    return counted.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def _spelled(found: list[DataFrame], words: DataFrame) -> DataFrame:
    """(lang, phrase, size, f): phrases with their words in place of the hashes. A common word is met in several tasks."""
    every = None
    for rows in found:
        own = F.array_compact(F.array(*[c for c in rows.columns if c != "f"])).alias("ws")
        rows = rows.select(own, "f")
        every = rows if every is None else every.unionByName(rows)
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    known = words.select("lang", F.col("phrase").alias("word"), F.xxhash64("lang", "phrase").alias("w"), salts).hint("merge")
    each = every.select("ws", "f", F.posexplode("ws").alias("pos", "w"))
    each = each.withColumn("salt", F.pmod(F.xxhash64("ws"), F.lit(_SALTS)).cast("int"))
    made = each.join(known, ["w", "salt"]).groupBy("ws", "f").agg(
        F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("spelled")
    )
    return made.select(
        "lang", F.array_join(F.transform("spelled", lambda s: s["word"]), " ").alias("phrase"), F.size("ws").alias("size"), "f"
    )


def _salted_join(rows: DataFrame, counts: DataFrame, part: str, named: str) -> DataFrame:
    """Adds the count of ``part`` as ``named``. A part that many phrases hold is met in several tasks.

    The counts grow with the texts and are never broadcast: Spark goes by the size of their files, which are
    compressed and hold each row once for all salts.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    known = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(named), salts).hint("merge")
    return rows.join(known, ["lang", part, "salt"])


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, min_count: int = 30, longest: int = 4, share: int = 80, top: int = 2000, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a``, ``l`` and ``r`` count the phrase and the parts of its weakest cut, whose score is
    floor(2000000 * a / (l + r)). Phrases inside a longer one with ``share`` percent of their count are left out.
    """
    if filter_bits < BITMAP_ROW or filter_bits & (filter_bits - 1):
        raise ValueError(f"filter_bits must be a power of two, {BITMAP_ROW} or more")
    context = docs.sparkSession.sparkContext
    words = stored(word_counts(docs).where((F.col("f") >= min_count) | F.col("phrase").isNull()))
    totals = words.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    words = words.where("phrase IS NOT NULL")
    known = (context.broadcast(bitmap(words.select(F.xxhash64("lang", "phrase").alias("hash")), filter_bits)),)
    lists = []
    for lengths in passes(longest):
        lists.append(stored(phrase_counts(docs, known, min_count, lengths)))
        if lengths[0] < 4 and lengths[-1] < longest:  # longer ones are told by their pairs and triples
            own = _words(lengths[0])
            hashes = lists[-1].where(F.col(_words(lengths[-1])[-1]).isNull()) if len(lengths) > 1 else lists[-1]
            known += (context.broadcast(bitmap(hashes.select(F.xxhash64(*own).alias("hash")), filter_bits)),)
    found = stored(_spelled(lists, words))
    counts = words.select("lang", "phrase", "f").unionByName(found.select("lang", "phrase", "f"))
    k = F.explode(F.expr("sequence(1, size - 1)")).alias("k")
    cuts = found.select("lang", "phrase", "size", F.col("f").alias("a"), k).select(
        "lang", "phrase", "a", "k",
        F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("rest"),
        F.expr(f"CAST(pmod(xxhash64(phrase), {_SALTS}) AS INT)").alias("salt"),
    )
    cuts = _salted_join(_salted_join(cuts, counts, "first", "l"), counts, "rest", "r")
    cuts = cuts.withColumn("wide_a", _wide("a")).withColumn("both", _wide("l") + _wide("r"))
    score = F.expr("CAST((wide_a * 2000000) DIV both AS BIGINT)")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w"))
    # contiguous parts of at least two words of each longer phrase
    parts = found.where("size > 2").withColumn("ws", F.split("phrase", " ", -1)).select(
        "lang", "f", "ws", F.explode(F.expr("sequence(2, size - 1)")).alias("words")
    ).select("lang", "f", "ws", "words", F.explode(F.expr("sequence(1, size(ws) - words + 1)")).alias("at"))
    longer = parts.groupBy("lang", F.expr("array_join(slice(ws, at, words), ' ')").alias("phrase")).agg(F.max("f").alias("longer"))
    hidden = F.coalesce(_wide("longer") * 100 >= _wide("a") * share, F.lit(False))
    kept = weakest.join(longer.hint("merge"), ["lang", "phrase"], "left").where(~hidden)
    order = [F.desc("w.score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_RANKS))).orderBy(*order)
    kept = kept.withColumn("place", F.row_number().over(some)).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "w.l", "w.r", "n", "w.score"
    )
