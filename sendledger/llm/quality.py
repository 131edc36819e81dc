"""Quality and toxicity by weak labels: labellers vote, EM weighs them, a hashed linear scorer decides.

Two questions are put to each document: is it junk, is it toxic. Overlapping labellers vote
on each: signs of style, stop words, an insult list, word lists learned from
labelled documents, and the given labels, which abstain on most documents. A learned list holds
hashes that are significantly commoner in toxic documents of their language, each with its evidence;
it votes yes where the evidence of a document's words is enough and abstains elsewhere. The vote patterns
of all documents are counted; expectation-maximisation over the counts estimates how reliable
each labeller is. The posteriors of a bounded sample
of documents (``max_training``, by hash, the classes alike) train one linear scorer per question over hashed words
and votes, by full gradients summed over the sample's partitions. The scorer then reads every
document; those at 0.5 or more for either question are rejected.

Parameters that bound the fitting: ``max_labelled`` labelled documents (by hash, toxic and others
alike) for the word lists, ``max_training`` documents for the scorer. A class with fewer documents than
its part of a bound gives them all and leaves the rest to the others. Counts of vote patterns, votes and scores
cover all documents.

Defined results: a null, empty or wordless text casts no votes for junk or insult and is
scored like any other. Labels that are null, or that name no document, are ignored; a
document with several labels takes the largest of each. Without labels the learned lists and
the given labels abstain. Repeated rows are scored alike. Empty tables give an empty result; other columns are
ignored by ``score_documents`` and carried along by ``keep_good``.
"""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sendledger.llm.common import pieces, stored
from sendledger.llm.decontaminate import words
from sendledger.llm.weak import ABSTAIN, Linear, Reliabilities, choose, feature_sums, flat, sigmoid

_BITS = 18
FEATURES = 2**_BITS
MAX_LABELLED = 20_000
MAX_TRAINING = 20_000
_MEMO_WORDS = 200_000  # words whose features a task remembers, about 50 MB
_ROUNDS = 40
_LISTED = 10_000  # hashes a learned list holds at most
_CHANCE = 1e-5  # a hash is listed if it stands in so many toxic documents by about this chance or less
_TELLING = math.log(4)  # least evidence of a hash; long documents would add up many weaker ones
_ENOUGH = math.log(50)  # evidence of the listed words of a document for a vote
_LEAST, _EFFECT = 5.0, 0.12  # of a feature of the scorer; many weaker ones together reject clean documents
_PARTS = 6  # of the training sample
JUNK, TOXIC = 7, 4  # labellers of either question, the given labels aside

# Frequent words of four languages, and insults.
_STOP = frozenset(
    "the of and to in is it that for on with as was are be this by at from or an "
    "der die das und ist von mit den dem ein eine zu im auf für nicht auch sich des "
    "de la el que y en los las un una por con para del se su al es "
    "le les et des du une dans pour pas sur par au qui est".encode().split()
)
_INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash scum clown clowns "
    "garbage imbecile fool fools cretin jerk bastard filthy vermin degenerate".encode().split()
)
_HASH = xxhash.xxh64_intdigest
_EVERY = 0  # a hash that stands for any document
_UPPER, _LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))


def _hashes(word: bytes) -> tuple[int, int, int]:
    """Of a word and of its first four and five bytes, which inflected words share."""
    return _HASH(word), _HASH(word[:4], 1), _HASH(word[:5], 1)


_PACK, _SHIFT = struct.Struct("<4i").pack, 64 - _BITS


class _Memo(dict):
    """Word -> its three feature buckets and its flags, as bytes."""

    def __init__(self, lists: tuple[frozenset[int], ...]):
        super().__init__()
        self.lists = lists

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        a, b, c = found = _hashes(word)
        flags = _STOP_FLAG * (word in _STOP) + _INSULT_FLAG * (word in _INSULTS)
        for k, listed in enumerate(self.lists):
            if not listed.isdisjoint(found):
                flags |= 1 << k
        value = self[word] = _PACK(a >> _SHIFT, b >> _SHIFT, c >> _SHIFT, flags)
        return value


# Flags of a word: bits 0 and 1 say that a learned list has it.
_LIST_FLAGS, _STOP_FLAG, _INSULT_FLAG = 3, 4, 8


class Learned:
    """Hashes that go with toxic documents, from two halves of the labelled ones, with their evidence:
    the logarithm of how many times more often a toxic document holds them.

    It also remembers the features of the words that a worker has read.
    """

    def __init__(self, *toxic: dict[int, float]):
        self.toxic = toxic or ({}, {})
        self.memo = _Memo(tuple(frozenset(t) for t in self.toxic))

    def __reduce__(self):
        return Learned, self.toxic

    def read(self, text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words of a text, their three feature buckets each, and their flags."""
        found, memo = words(text), self.memo
        numbers = np.frombuffer(b"".join([memo[w] for w in found]), np.int32).reshape(-1, 4)
        return found, numbers[:, :3], numbers[:, 3]

    def votes(self, text: str | None, found: list[bytes], numbers: np.ndarray, flags: np.ndarray) -> tuple[list[int], list[int]]:
        listed = []
        for k, known in enumerate(self.toxic):
            # words of one stem count once each, by their strongest hash
            own = {found[i] for i in np.flatnonzero(flags >> k & 1)}
            evidence = sum(max(known.get(h, 0.0) for h in _hashes(w)) for w in own)
            listed.append(1 if evidence >= _ENOUGH else ABSTAIN)
        return votes(text, found, numbers, flags, listed)


def votes(
    text: str | None, found: list[bytes], numbers: np.ndarray, flags: np.ndarray, listed: list[int]
) -> tuple[list[int], list[int]]:
    """What the labellers of junk and of toxicity say: 1 yes, 0 no, 2 nothing. A sign's absence says nothing."""
    n = len(found)
    if not n:
        return [ABSTAIN] * JUNK, [ABSTAIN] * TOXIC
    raw = text.encode()
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    symbols = (len(raw) - len(raw.translate(None, b"%$#&*~^"))) / n
    bars, bangs = raw.count(b"|") / n, raw.count(b"!!") / n
    repeats = float((numbers[1:, 0] == numbers[:-1, 0]).mean()) if n > 1 else 0.0
    stops = float((flags & _STOP_FLAG > 0).mean())

    def sign(fires: bool) -> int:
        return 1 if fires else ABSTAIN

    distinct = len(set(found))
    capital = capitals >= 0.5 * letters and letters >= 10
    signs = [
        symbols >= 0.3,
        capital,
        bars >= 0.2,
        bangs >= 0.2,
        n >= 10 and repeats >= 0.2,
        n >= 20 and distinct <= 0.15 * n,
    ]
    # prose: none of these, hardly a symbol, and frequent words stand between the others
    calm = not any(signs) and symbols + bars + bangs <= 0.02 and (stops >= 0.05 or n < 20)
    junk = [*map(sign, signs), 0 if calm else ABSTAIN]
    insults = len(_INSULTS.intersection(found)) if (flags & _INSULT_FLAG).any() else 0
    toxic = [int(insults > 0), *listed, sign(insults > 1)]
    return junk, toxic


def _features(numbers: np.ndarray, junk: list[int], toxic: list[int]) -> np.ndarray:
    """Distinct word buckets, then one feature for each vote."""
    cast = [FEATURES + 3 * k + v for k, v in enumerate(junk + toxic)]
    return np.concatenate((np.unique(numbers), np.array(cast, np.int64)))


_WIDTH = FEATURES + 64


def _given(labels: DataFrame) -> DataFrame:
    """(doc_id, junk_label, toxic_label): the given labels as votes."""
    def vote(column):
        return F.when(column.isNull(), ABSTAIN).otherwise(column.cast("int"))

    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .select("doc_id", vote(F.col("quality") <= 0).alias("junk_label"), vote(F.col("toxic") > 0).alias("toxic_label"))
    )


def _sample(rows: DataFrame, kind: str, bound: int) -> tuple[DataFrame, dict[int, float]]:
    """At most ``bound`` rows by hash of ``doc_id``, as evenly from each kind as there are rows, and how many
    rows each chosen row of a kind stands for."""
    rows = stored(rows)
    sizes = sorted((r["count"], r[kind]) for r in rows.groupBy(kind).count().collect())  # a few kinds
    parts, stands, left = [rows.limit(0)], {}, bound
    for k, (size, which) in enumerate(sizes):  # what a rare kind leaves goes to the others
        take = min(size, left // (len(sizes) - k))
        left -= take
        stands[which] = size / max(1, take)
        parts.append(rows.where(F.col(kind) == which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take))
    return stored(functools.reduce(DataFrame.unionByName, parts)), stands


def _learn(docs: DataFrame, given: DataFrame, max_labelled: int) -> Learned:
    """Word lists from a bounded sample of the labelled documents, in two halves.

    Whether a hash goes with toxic documents is asked inside each language and added up, so a
    language's share of the documents does not matter, nor how common toxic ones are.
    """
    marked = given.where(F.col("toxic_label") < ABSTAIN).select("doc_id", F.col("toxic_label").alias("toxic"))
    chosen, _ = _sample(marked.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic", max_labelled)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    texts = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(chosen), "doc_id")  # max_labelled ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [
                np.array([_EVERY, *{h for w in set(words(t)) for h in _hashes(w)}], np.uint64).view(np.int64)
                for t in batch.column("text").to_pylist()
            ]
            kept = [batch.column(c) for c in ("half", "lang", "toxic")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int64()))], ["half", "lang", "toxic", "hashes"])

    read = texts.select("text", "toxic", "lang", half.alias("half")).mapInArrow(run, "half long, lang string, toxic int, hashes array<long>")
    yes, no = F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))
    each = read.select("half", "lang", "toxic", F.explode("hashes").alias("hash"))
    counted = stored(each.groupBy("hash", "half", "lang").agg(yes.alias("yes"), no.alias("no")))
    every = counted.where(F.col("hash") == _EVERY).select("half", "lang", F.col("yes").alias("toxic"), F.col("no").alias("other"))
    rows, held = F.col("toxic") + F.col("other"), F.col("yes") + F.col("no")

    def told(count, of, among):  # against what chance gives, also right for small counts
        return F.when(count > 0, count * F.log(count * rows / (of * among))).otherwise(0.0)

    yes, no, toxic, other = (F.col(c) for c in ("yes", "no", "toxic", "other"))
    deviance = told(yes, held, toxic) + told(no, held, other) + told(toxic - yes, rows - held, toxic) + told(other - no, rows - held, other)
    joined = counted.where(F.col("hash") != _EVERY).join(F.broadcast(every), ["half", "lang"])  # a row for each language
    summed = joined.groupBy("hash", "half").agg(
        F.sum(F.when(yes * rows > held * toxic, deviance).otherwise(-deviance)).alias("surprise"),
        F.sum((yes + 0.5) * (other + 1) / rows).alias("for"),
        F.sum((no + 0.5) * (toxic + 1) / rows).alias("against"),
    )
    often = summed.where((F.col("surprise") >= -math.log(_CHANCE)) & (F.col("for") > F.col("against")))
    often = often.withColumn("evidence", F.log(F.col("for") / F.col("against"))).where(F.col("evidence") >= _TELLING)
    lists = []
    for k in (0, 1):
        best = often.where(F.col("half") == k).orderBy(F.desc("surprise"), "hash").limit(_LISTED).collect()
        lists.append({r.hash % 2**64: r.evidence for r in best})
    return Learned(*lists)


def _voted(docs: DataFrame, learned: Learned) -> DataFrame:
    """(doc_id, junk, toxic): the votes of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            known = shared.value
            cast = [known.votes(t, *known.read(t)) for t in batch.column("text").to_pylist()]
            whole = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([c[0] for c in cast], whole), pa.array([c[1] for c in cast], whole)],
                ["doc_id", "junk", "toxic"],
            )
        shared.value.memo.clear()  # a worker goes on to other tasks

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, junk array<int>, toxic array<int>")


def _weigh(voted: DataFrame, column: str, labellers: int) -> tuple[Reliabilities, list[tuple]]:
    """The reliabilities, and the patterns of votes that speak for yes."""
    counted = voted.groupBy(column, f"{column}_label").count().collect()  # at most 3^(labellers + 1) rows
    fitted = Reliabilities(labellers + 1, 1)
    if not counted:
        return fitted, []
    cast, group = np.array([[*r[column], r[f"{column}_label"]] for r in counted]), np.zeros(len(counted), int)
    fitted.fit(cast, group, np.array([float(r["count"]) for r in counted]))
    likely = fitted.posterior(cast, group) >= 0.5
    return fitted, [(r[column], r[f"{column}_label"]) for r, yes in zip(counted, likely) if yes]


def _kinds(voted: DataFrame, likely: tuple[list, list]) -> DataFrame:
    """(doc_id, kind): 2 for documents that the votes hold for toxic, 1 for junk, 0 for others."""
    spark = voted.sparkSession
    for column, patterns in zip(("junk", "toxic"), likely):
        known = spark.createDataFrame(
            [(*p, True) for p in patterns], f"{column} array<int>, {column}_label int, is_{column} boolean"
        )
        voted = voted.join(F.broadcast(known), [column, f"{column}_label"], "left")
    kind = F.when(F.col("is_toxic"), 2).when(F.col("is_junk"), 1).otherwise(0)
    return voted.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(kind).alias("kind"))


class Weights:
    """The trained scorer: a weight for each feature and question, and the biases."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Features, the row of each, and what is wanted of the rows of a training batch and their weight."""
    features, row = flat(np.frombuffer(f, np.int32) for f in batch.column("features").to_pylist())
    return features, row, np.stack([batch.column(c).to_numpy() for c in ("junk", "toxic")]), batch.column("weight").to_numpy()


def _total(df: DataFrame, kind, shape: tuple[int, ...]) -> np.ndarray:
    """Adds the packed sums of a few partitions, one at a time."""
    total = np.zeros(shape)
    for r in df.collect():
        total += np.frombuffer(r.sums, kind).reshape(shape)
    return total


def _summing(add, kind):
    """A mapInArrow function: one packed sum for each partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                part = add(*_rows(batch))
                sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.astype(kind).tobytes()], pa.binary())], ["sums"])

    return run


def _train(
    docs: DataFrame, given: DataFrame, kinds: DataFrame, learned: Learned, weighed: tuple, max_training: int
) -> Weights:
    """The linear scorer of both questions, trained on a bounded sample with posterior labels.

    The sample holds toxic, junk and other documents alike, as the votes have them, so that a rare class
    is learned; each row then weighs as many documents as it stands for.
    One pass chooses the telling features, a second keeps them alone; the gradients then run over small rows.
    """
    spark = docs.sparkSession
    ids, stands = _sample(kinds, "kind", max_training)
    stands_for = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(w))) for k, w in stands.items()], F.lit(1.0))
    chosen = ids.join(given, "doc_id", "left").select(
        "doc_id", stands_for.alias("weight"), *[F.coalesce(c, F.lit(ABSTAIN)).alias(c) for c in ("junk_label", "toxic_label")]
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_training ids
    shared = spark.sparkContext.broadcast((learned, weighed))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (junk_fit, toxic_fit) = shared.value
        zero = np.zeros(1, int)
        for batch in pieces(batches):
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("text", "junk_label", "toxic_label", "weight")]
            for text, junk_label, toxic_label, weight in zip(*columns):
                found, numbers, flags = known.read(text)
                junk, toxic = known.votes(text, found, numbers, flags)
                cast = (junk_fit, [*junk, junk_label]), (toxic_fit, [*toxic, toxic_label])
                wanted = [float(f.posterior(np.array([v]), zero)[0]) for f, v in cast]
                rows.append((_features(numbers, junk, toxic).astype(np.int32).tobytes(), *wanted, weight))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), *[pa.array(c, pa.float64()) for c in columns[1:]]],
                ["features", "junk", "toxic", "weight"],
            )
        known.memo.clear()

    schema = "features binary, junk double, toxic double, weight double"
    sample = stored(texts.mapInArrow(prepare, schema).repartition(_PARTS))
    counted = sample.mapInArrow(_summing(lambda *rows: feature_sums(*rows[:3], _WIDTH), np.float32), "sums binary")
    sums = _total(counted, np.float32, (3, _WIDTH + 1))  # 3 MB from each of a few partitions
    used, own = choose(sums, least=_LEAST, effect=_EFFECT, seldom=0, shrink=1.0)

    def keep_used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(_WIDTH, -1, np.int32)
        number[used] = np.arange(len(used))
        for batch in pieces(batches):
            kept = [number[np.frombuffer(f, np.int32)] for f in batch.column("features").to_pylist()]
            kept = pa.array([k[k >= 0].tobytes() for k in kept], pa.binary())
            rest = ["junk", "toxic", "weight"]
            yield pa.RecordBatch.from_arrays([kept, *[batch.column(c) for c in rest]], ["features", *rest])

    small = stored(sample.mapInArrow(keep_used, schema))
    means = small.agg(*[F.sum(F.col(c) * F.col("weight")) / F.sum("weight") for c in ("junk", "toxic")]).first()
    model = Linear(own, np.array([m or 0.0 for m in means]))
    for _ in range(_ROUNDS):
        step = small.mapInArrow(_summing(model.gradient, np.float64), "sums binary")
        model.move(_total(step, np.float64, (2, 2, len(used) + 1)))
    return Weights(model.spread(used, _WIDTH), model.bias)


class Scorer:
    """The fitted labellers and weights, ready to score texts."""

    def __init__(self, learned: Learned, model: Weights):
        self.learned, self.weights, self.bias = learned, model.weights, model.bias
        self.used = model.weights.any(axis=0)

    def score(self, text: str | None) -> tuple[float, float]:
        found, numbers, flags = self.learned.read(text)
        telling = numbers[self.used[numbers]]  # the others weigh nothing
        features = _features(telling, *self.learned.votes(text, found, numbers, flags))
        raw = self.weights[:, features].sum(axis=1, dtype=np.float64) + self.bias
        return tuple(sigmoid(raw).tolist())


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_training: int = MAX_TRAINING) -> Scorer:
    given = stored(_given(labels))
    learned = _learn(docs, given, max_labelled)
    voted = _voted(docs, learned).join(given, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(ABSTAIN)) for c in ("junk_label", "toxic_label")}
    )
    voted = stored(voted)
    weighed, likely = zip(_weigh(voted, "junk", JUNK), _weigh(voted, "toxic", TOXIC))
    return Scorer(learned, _train(docs, given, _kinds(voted, likely), learned, weighed, max_training))


def score_documents(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, junk, toxic (probabilities), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            scores = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            junk, toxic = (pa.array([s[k] for s in scores], pa.float64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), junk, toxic], ["doc_id", "junk", "toxic"])
        shared.value.learned.memo.clear()

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, junk double, toxic double")
    return scored.withColumn("kept", (F.col("junk") < 0.5) & (F.col("toxic") < 0.5))


def keep_good(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            good = [max(shared.value.score(t)) < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))
        shared.value.learned.memo.clear()

    return docs.mapInArrow(run, docs.schema)
