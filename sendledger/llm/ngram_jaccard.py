"""Near duplicates by word shingles: prefixes under several global token orders.

Two sets of n tokens with a Jaccard similarity of t share a token among the first
n - ceil(t * n) + 1 of each, whatever order all sets are sorted by. So a pair is
a candidate only if its prefixes meet under *every* one of three orders; the order filters are
intersected, then the pair is verified on the whole sets. All orders put rare tokens
first (by document frequency, or by its power of two) and break ties by different hashes.
A token of one set alone can meet nothing, so a set whose prefix holds only such
tokens is done.

How the work is spread:

1. Shingles are hashed in each task. Rows with equal sets are one class, so copies
   are counted once; a class with a large share of all rows goes on from its first row only.
2. Tokens meet by hash bucket, packed in blocks, and get their document frequency.
   Tokens that a large share of all rows hold are counted beforehand from per-task
   counts, kept in a list of bounded size, and never sent to one bucket.
3. Tokens of two or more sets return to their set, which keeps its prefixes if it
   can still have a partner.
4. Star rounds: each token's sets are compared with one hub, so a group of n near
   copies costs n comparisons for each token, not n * n. Linked sets become one component.
   A last round compares what is left: small components pair by pair, and sets with
   larger components, once for each component, in blocks of members. No pair inside a
   component is formed.

Defined results: a null, empty or wordless text has an empty set, links with nothing and
is its own component. A text of fewer words than the width is one shingle. Rows with
one set are linked. Rows may repeat a ``doc_id``; a null ``doc_id`` links but cannot name a
component (its component is null if no row of it has an id). An empty table gives an
empty result; other columns are ignored. Sets are known and shingles counted by 64-bit
hashes, shingles of different sets compared by 56 bits of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sendledger.llm.common import pieces, stored

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_HUBS = (0x1F3A5C7E9B2D4F60, 0x6A09E667F3BCC908, 0x3C6EF372FE94F82B)
_BLOCK = 2_000_000  # tokens a task packs at once, about 100 MB
_BUCKET = 2_000_000  # tokens of a bucket
_SHARE = 256  # a token or class with one in so many of all rows is common
_MANY = 1000  # and this many at least
_MOST_COMMON = 100_000  # tokens in the list of common ones, 1.6 MB
_MEMO_WORDS = 500_000
_FEW_KEYS = 100_000  # set keys that may be broadcast, 1 MB
_LARGE = 8  # sets of a component that is compared as a whole
_SET_BLOCK = 1000  # sets compared with as many others in one task


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASH_OF = _WordHashes()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles. ``bytes.lower`` and ``split`` know ASCII alone."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([_HASH_OF[w] for w in words], np.uint64)
    size = min(width, len(words))
    found = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        found = (found ^ hashes[j : len(words) - size + 1 + j]) * _STEP
        found ^= found >> np.uint64(29)
    return np.unique(found)


def _class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n) for each row, and rows (common, counts) of tokens frequent within a block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(4, len(sets) // (2 * _SHARE))
            return pa.RecordBatch.from_arrays(
                [pa.array([None], id_type), pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                 pa.array([tokens[often].view(np.int64)], pa.list_(pa.int64())),
                 pa.array([counts[often]], pa.list_(pa.int64()))],
                names,
            )

        names, id_type = ["doc_id", "key", "n", "common", "counts"], None
        for batch in pieces(batches):
            id_type, keys, sizes = batch.column("doc_id").type, [], []
            for text in batch.column("text").to_pylist():
                tokens = shingle_set(text, width)
                keys.append(_class_of(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
                sets.append(tokens)
                size += len(tokens)
                if size >= _BLOCK:
                    yield frequent()
                    sets, size = [], 0
            none = pa.nulls(len(keys), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), none, none], names
            )
        if sets:
            yield frequent()
        _HASH_OF.clear()  # a worker goes on to other tasks

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, key long, n long, common array<long>, counts array<long>"
    )


_TOKEN_BYTES = 7  # of a hash that travel; sets are counted by whole hashes
_TOKEN_MASK = np.uint64(2 ** (8 * _TOKEN_BYTES) - 1)


def _even(values: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Part of each value: its upper 32 bits scaled to the number of parts."""
    return ((values >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _short(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :_TOKEN_BYTES]).tobytes()


def _whole(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _TOKEN_BYTES, 8), np.uint8)
    out[:, :_TOKEN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _TOKEN_BYTES)
    return out.view(np.uint64).reshape(-1)


_PACKED = ["bucket", "keys", "counts", "tokens", "freqs"]


def _pack(bucket: int, keys, counts, tokens, freqs) -> tuple:
    return (bucket, keys.astype(np.uint64).tobytes(), counts.astype(np.int32).tobytes() if counts is not None else None,
            _short(tokens.astype(np.uint64)), np.minimum(freqs, 2**31 - 1).astype(np.int32).tobytes() if freqs is not None else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * 4
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], _PACKED)


def _by_set(keys: np.ndarray, tokens: np.ndarray, freqs: np.ndarray, parts: int) -> list[tuple]:
    """Packed rows for the sets' own buckets, numbered below zero."""
    part = _even(keys, 64, parts)
    order = np.argsort(part, kind="stable")
    part, keys, tokens, freqs = part[order], keys[order], tokens[order], freqs[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, int)
    return [
        _pack(-1 - int(part[a]), keys[a:b], None, tokens[a:b], freqs[a:b])
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)])
    ]


def _packed_tokens(docs: DataFrame, width: int, parts: int, common: np.ndarray, counts: np.ndarray, hot: dict) -> DataFrame:
    """Blocks of tokens by token bucket; sizes and common tokens of each set by set bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, keys, size = [], {}, 0

        def block() -> Iterator[pa.RecordBatch]:
            names = np.array(list(keys), np.int64).view(np.uint64)
            lengths = np.array([len(s) for s in sets])
            tokens, owner = np.concatenate(sets) & _TOKEN_MASK, np.repeat(np.arange(len(sets)), lengths)
            known = np.zeros(len(tokens), bool)
            if len(common):
                at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                known = common[at] == tokens
                own, freq = names[owner[known]], counts[at[known]]
            else:
                own, freq = names[:0], np.empty(0, np.int64)
            # a set's size goes along as an entry of frequency 0
            yield _batch(_by_set(
                np.concatenate((names, own)), np.concatenate((lengths.astype(np.uint64), tokens[known])),
                np.concatenate((np.zeros(len(names), np.int64), freq)), parts,
            ))
            tokens, owner = tokens[~known], owner[~known]
            bucket = _even(tokens, 8 * _TOKEN_BYTES, parts)
            order = np.argsort(bucket.astype(np.uint16) if parts < 2**16 else bucket, kind="stable")
            bucket, tokens, owner = bucket[order], tokens[order], owner[order]
            rows = []
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
            for a, b in zip(edges, [*edges[1:], len(bucket)]):
                first = np.flatnonzero(np.concatenate(([True], owner[a + 1 : b] != owner[a : b - 1])))
                rows.append(_pack(int(bucket[a]), names[owner[a:b][first]], np.diff(np.append(first, b - a)), tokens[a:b], None))
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = shingle_set(text, width)
                if not len(tokens):
                    continue
                key = _class_of(tokens)
                if key in keys or hot.get(key, doc_id) != doc_id:
                    continue
                keys[key] = True
                sets.append(tokens)
                size += len(tokens)
                if size >= _BLOCK:
                    yield from block()
                    sets, keys, size = [], {}, 0
        if sets:
            yield from block()
        _HASH_OF.clear()

    schema = "bucket int, keys binary, counts binary, tokens binary, freqs binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    data = b"".join(table.column(name).to_pylist())
    return _whole(data) if name == "tokens" else np.frombuffer(data, kind)


def _counted(parts: int):
    """For a token bucket: the tokens of two or more sets with their frequency, by set bucket."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        tokens = _column(table, "tokens", np.uint64)
        keys = np.repeat(_column(table, "keys", np.uint64), _column(table, "counts", np.int32))
        order = np.lexsort((keys, tokens))
        tokens, keys = tokens[order], keys[order]
        fresh = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])))
        tokens, keys = tokens[fresh], keys[fresh]  # a class that several blocks hold counts once
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        sizes = np.diff(np.append(starts, len(tokens)))
        freqs = np.repeat(sizes, sizes)
        shared = freqs > 1
        return pa.Table.from_batches([_batch(_by_set(keys[shared], tokens[shared], freqs[shared], parts))])

    return run


def _mixed(tokens: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = (tokens ^ seed) * _STEP
    return (h ^ (h >> np.uint64(32))) * seed


def _prefixes(similarity: int):
    """For a set bucket: each set that can have a partner, its shared tokens and its prefixes."""
    names = ["key", "n", "tokens", "first", "second", "third"]
    longs = pa.list_(pa.int64())
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), longs, longs, longs, longs])))

    def run(table: pa.Table) -> pa.Table:
        keys, tokens = _column(table, "keys", np.uint64), _column(table, "tokens", np.uint64)
        freqs = _column(table, "freqs", np.int32)
        order = np.lexsort((tokens, freqs > 0, keys))
        keys, tokens, freqs = keys[order], tokens[order], freqs[order]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (tokens[1:] != tokens[:-1]) | ((freqs[1:] > 0) != (freqs[:-1] > 0))))
        keys, tokens, freqs = keys[fresh], tokens[fresh], freqs[fresh]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        ends = np.append(starts[1:], len(keys))
        sizes = tokens[starts].astype(np.int64)  # the entry of frequency 0 comes first
        prefix = sizes - (similarity * sizes + 99) // 100 + 1
        room = prefix - (sizes - (ends - starts - 1))  # what tokens of this set alone leave of the prefix
        rows = []
        for a, b, n, m in zip(starts, ends, sizes, room):
            if m <= 0:
                continue
            own, freq = tokens[a + 1 : b], freqs[a + 1 : b]
            power = np.log2(freq).astype(np.int64)
            orders = [np.lexsort((_mixed(own, seed), rank))[:m] for seed, rank in zip(_SEEDS, (freq, power, power))]
            rows.append((keys[a].astype(np.int64), n, own.view(np.int64), *[own[o].view(np.int64) for o in orders]))
        columns = zip(*rows) if rows else [[]] * 6
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _spread(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges reach, by smallest neighbour and pointer jumps."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    roots = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("root").alias("near")
        )
        stepped = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jumped = stepped.join(
            stepped.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left"
        ).select("node", "old", F.coalesce("further", "root").alias("root"))
        jumped = stored(jumped)
        roots = jumped.select("node", "root")
        if jumped.where("old <> root").isEmpty():
            return roots


def _possible(similarity: int):
    """Whether the first token that two similar sets share can be this one, by sizes and places.

    Both list their ``d`` shared tokens in one order. What they have in common is at most
    the shorter of the parts before the token, the token, and the shorter of the parts behind it.
    The smaller set must also have enough tokens from this one on to reach the overlap
    that a set of its own size would need.
    """
    before = F.least("place", "other_place")
    behind = F.least(F.col("d") - F.col("place"), F.col("other_d") - F.col("other_place"))
    both, sizes = before + behind, F.col("n") + F.col("other_n")
    close = F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * similarity
    rest = F.when(F.col("n") < F.col("other_n"), F.col("d") - F.col("place")).when(
        F.col("n") > F.col("other_n"), F.col("other_d") - F.col("other_place")
    ).otherwise(behind)
    enough = (100 + similarity) * rest >= 2 * similarity * F.least("n", "other_n")
    return close & enough & ((100 + similarity) * both >= similarity * sizes)


_OTHER = {"key": "other", "n": "other_n", "d": "other_d", "place": "other_place", "comp": "other_comp"}


def _hub_pairs(members: DataFrame, turn: int, similarity: int) -> DataFrame:
    """Each token's sets against its hub: pairs of different components."""
    salt = F.lit(_HUBS[turn])
    hubs = members.groupBy("token").agg(
        F.min(F.col("key").bitwiseXOR(salt)).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")
    ).where("low < high").select("token", F.col("hub").bitwiseXOR(salt).alias("other"))
    hubs = hubs.join(members.withColumnsRenamed(_OTHER), ["token", "other"])
    found = members.join(hubs, "token").where((F.col("comp") != F.col("other_comp")) & _possible(similarity))
    return found.select("key", "other")


def _block_links(similarity: int):
    """For some sets and a block of a component's members: one link of each set that has any."""

    def run(asked: pa.Table, members: pa.Table) -> pa.Table:
        found = ([], [])
        if asked.num_rows and members.num_rows:
            lists = members.column("tokens").combine_chunks()
            tokens, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            keys, sizes = members.column("key").to_numpy(), members.column("n").to_numpy()
            order = np.argsort(tokens, kind="stable")
            owner = np.repeat(np.arange(len(keys)), lengths)[order]
            distinct, first, count = np.unique(tokens[order], return_index=True, return_counts=True)
            for key, n, own in zip(asked.column("key").to_pylist(), asked.column("n").to_pylist(), asked.column("tokens")):
                own = own.values.to_numpy()
                at = np.minimum(np.searchsorted(distinct, own), len(distinct) - 1)
                at = at[distinct[at] == own]
                holders = np.repeat(first[at] - (np.cumsum(count[at]) - count[at]), count[at]) + np.arange(count[at].sum())
                both = np.bincount(owner[holders], minlength=len(keys))
                linked = np.flatnonzero(100 * both >= similarity * (n + sizes - both))
                if len(linked):
                    found[0].append(key)
                    found[1].append(int(keys[linked[0]]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def _links_to_large(mixed: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links of sets to larger components with which they share a token.

    A set is asked about a component once, whatever tokens and members they share. The members
    lie in blocks; the sets asked about a component go to each of its blocks.
    """
    large = mixed.where(F.col("size") >= _LARGE).groupBy("token", "comp", "size").agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("place").alias("most_before"),
        F.max(F.col("d") - F.col("place")).alias("most_behind"),
    )
    large = large.withColumnsRenamed({"comp": "large", "size": "large_size"})
    both = F.least("place", "most_before") + F.least(F.col("d") - F.col("place"), F.col("most_behind"))
    asked = mixed.join(large, "token").where(
        (F.struct("size", "comp") < F.struct(F.col("large_size"), F.col("large")))
        & (F.col("least_n") * similarity <= F.col("n") * 100)
        & (F.col("most_n") * 100 >= F.col("n") * similarity)
        & ((100 + similarity) * both >= similarity * (F.col("n") + F.col("least_n")))
    )
    asked = stored(asked.select("key", "large", "large_size").distinct())
    blocks = asked.groupBy("large", "large_size").agg(F.count("*").alias("asking"))

    def parts(size: str):
        return F.ceil(F.col(size) / _SET_BLOCK).cast("int")

    def block(n):
        return F.pmod(F.xxhash64("key"), n).cast("int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    blocks = blocks.select("large", parts("large_size").alias("rows"), parts("asking").alias("columns"))
    whole = sets.select("key", "n", "tokens")
    asking = asked.select("key", "large").join(blocks, "large").join(_narrowed(whole, asked.select("key")), "key")
    asking = asking.withColumn("column", block(F.col("columns"))).withColumn("row", each(F.col("rows")))
    members = stored(nodes.select("key", F.col("comp").alias("large")).join(blocks, "large"))
    members = members.join(_narrowed(whole, members.select("key")), "key")
    members = members.withColumn("row", block(F.col("rows"))).withColumn("column", each(F.col("columns")))
    names = ["large", "row", "column", "key", "n", "tokens"]
    left = asking.select(*[F.col(c).alias(c) for c in names])  # new columns: both sides come from one table
    right = members.select(*[F.col(c).alias(c) for c in names])
    return left.groupBy(*names[:3]).cogroup(right.groupBy(*names[:3])).applyInArrow(
        _block_links(similarity), "a long, b long"
    )


def _left_links(postings: DataFrame, labels: DataFrame | None, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between components that the hubs left apart, all candidates compared."""
    nodes = sets.select("key")
    if labels is None:
        nodes = nodes.withColumn("comp", F.col("key"))
    else:
        nodes = nodes.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    nodes = stored(nodes.join(nodes.groupBy("comp").agg(F.count("*").alias("size")), "comp"))
    members = postings.join(nodes, "key")
    several = members.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    mixed = stored(members.join(several.select("token"), "token"))
    small = mixed.where(F.col("size") < _LARGE).drop("size")
    pairs = small.join(small.withColumnsRenamed(_OTHER), "token").where(
        (F.col("key") < F.col("other")) & (F.col("comp") != F.col("other_comp")) & _possible(similarity)
    )
    found = _linked(pairs.select("key", "other"), sets, similarity)
    return found.unionByName(_links_to_large(mixed, nodes, sets, similarity))


def _narrowed(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """The sets with one of these keys, without a shuffle where the keys are few."""
    keys = stored(keys.distinct())
    few = keys.count() <= _FEW_KEYS
    return sets.join(F.broadcast(keys) if few else keys, "key", "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under the other orders and whose sets are similar."""
    pairs = stored(pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct())
    sets = _narrowed(sets, pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))))

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("key").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    met = pairs.join(side("a", "second", "third"), "a").join(side("b", "second", "third"), "b")
    met = met.where(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third")).select("a", "b")
    whole = met.join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return whole.where(100 * both >= similarity * (F.col("a_n") + F.col("b_n") - both)).select("a", "b")


def _components(sets: DataFrame, similarity: int) -> DataFrame:
    """(key, comp) of every set that is linked with another."""
    postings = stored(sets.select("key", "n", F.size("tokens").alias("d"), F.posexplode("first").alias("place", "token")))
    labels = None
    for turn in range(len(_HUBS) + 1):
        if labels is None:
            members = postings.withColumn("comp", F.col("key"))
        else:
            members = postings.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        last = turn == len(_HUBS)
        if last:
            links = stored(_left_links(postings, labels, sets, similarity))
        else:
            links = stored(_linked(_hub_pairs(members, turn, similarity), sets, similarity))
        if links.isEmpty():
            if last:
                break
            continue
        edges = links
        if labels is not None:
            def named(name):
                return labels.select(F.col("key").alias(name), F.col("comp").alias(f"{name}_comp"))
            edges = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(
                F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")
            ).distinct()
        roots = _spread(edges)
        merged = roots.select(F.col("node").alias("comp"), "root")
        if labels is None:
            labels = roots.select(F.col("node").alias("key"), F.col("root").alias("comp"))
        else:
            old = labels.join(merged, "comp", "left").select("key", F.coalesce("root", "comp").alias("comp"))
            new = roots.select(F.col("node").alias("key"), F.col("root").alias("comp")).join(labels, "key", "left_anti")
            labels = stored(old.unionByName(new))
    return labels


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id. ``similarity`` is in percent."""
    spark = docs.sparkSession
    found = stored(_classes(docs, width))
    rows = found.where("common IS NULL").select("doc_id", "key", "n")
    classes = stored(
        rows.where("key IS NOT NULL").groupBy("key").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("size"), F.max("n").alias("n")
        )
    )
    total, tokens = classes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    many = max(_MANY, total // _SHARE)
    # at most _SHARE classes are that large
    hot = {r.key: r.first_id for r in classes.where(F.col("size") >= many).collect() if r.first_id is not None}
    often = (
        found.where("common IS NOT NULL")
        .select(F.explode(F.arrays_zip("common", "counts")).alias("c"))
        .groupBy("c.common")
        .agg(F.sum("c.counts").alias("count"))
        .where(F.col("count") >= many)
        .orderBy(F.desc("count"), "common")
        .limit(_MOST_COMMON)
        .toPandas()
    )
    common, first = np.unique(often["common"].to_numpy(np.int64).view(np.uint64) & _TOKEN_MASK, return_index=True)
    counts = often["count"].to_numpy(np.int64)[first]
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // _BUCKET + 1))
    packed = "bucket int, keys binary, counts binary, tokens binary, freqs binary"
    sets = stored(
        _packed_tokens(docs, width, parts, common, counts, hot)
        .groupBy("bucket").applyInArrow(_counted(parts), packed)
        .groupBy("bucket").applyInArrow(
            _prefixes(similarity),
            "key long, n long, tokens array<long>, first array<long>, second array<long>, third array<long>",
        )
    )
    labels = _components(sets, similarity)
    if labels is None:
        named = classes.select("key", F.col("first_id").alias("component"))
    else:
        labelled = classes.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        first = labelled.groupBy("comp").agg(F.min("first_id").alias("component"))
        named = labelled.join(first, "comp").select("key", "component")
    alone = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return rows.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id")
    )


def keep_first(docs: DataFrame, width: int = 5, similarity: int = 75) -> DataFrame:
    """The rows of ``docs`` that name their component, all columns kept (rows without an id stay)."""
    groups = near_duplicates(docs, width, similarity)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col("doc_id").alias("id")).join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
