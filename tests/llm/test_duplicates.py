"""Near duplicates, exact duplicates and repeated lines against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm.cases import awkward, docs_of, lower_ascii, words_of
from sendledger.llm import exact_dedup, line_dedup, ngram_jaccard


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(rows, similarity=75):
    """(doc_id, size, component) of each row, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return sorted(
        ((d, len(s), min(ids[find(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def joined(spark, rows, **options):
    found = ngram_jaccard.near_duplicates(docs_of(spark, rows), **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def near_groups(seed):
    """Groups of near copies of many sizes, passages that many share, and chains of small changes."""
    rng = random.Random(seed)
    passage = " ".join(words_of(rng, 30))
    texts = []
    for size in (1, 2, 3, 8, 60):
        base = words_of(rng, rng.randrange(30, 90), 100_000)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = f"n{rng.random()}"
            texts.append(" ".join(own))
    for _ in range(30):
        texts.append(passage + " " + " ".join(words_of(rng, rng.randrange(2, 40), 100_000)))
    chain = words_of(rng, 120, 100_000)
    for k in range(25):
        chain = list(chain)
        chain[4 * k] = f"c{k}"
        texts.append(" ".join(chain))
    texts += [texts[10]] * 15 + [" ".join(words_of(rng, n, 3)) for n in range(1, 8) for _ in range(4)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = near_groups(seed)
    assert joined(spark, rows) == components(rows)


def test_near_duplicates_with_common_tokens_and_classes(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "_MANY", 12)
    rows = near_groups(3)
    assert joined(spark, rows) == components(rows)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "_BUCKET", 200)
    rows = near_groups(4)
    assert joined(spark, rows, similarity=60) == components(rows, 60)


def test_near_duplicates_awkward(spark):
    rows = awkward()
    assert joined(spark, rows) == components(rows)
    assert joined(spark, []) == []
    assert joined(spark, [(1, None), (2, " ")]) == [(1, 0, 1), (2, 0, 2)]


def test_keep_first(spark):
    rows = near_groups(5)
    docs = docs_of(spark, rows)
    kept = ngram_jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in components(rows)})


def exact_plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.left(F.sha2(c, 256), F.lit(2)))])
def test_exact_groups(spark, digest):
    for rows in (awkward(), []):
        found = exact_dedup.exact_groups(docs_of(spark, rows), digest=digest)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == exact_plain(rows)


def test_keep_one(spark):
    rows = awkward()
    docs = docs_of(spark, rows)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    found = Counter((r.text or "", r.doc_id) for r in kept.collect())
    assert found == Counter({(t, k): 1 for t, k in {(t or "", k) for (_, t), (_, k, *_) in zip(sorted(rows, key=repr), exact_plain_in(rows))}})


def test_keep_one_with_a_map(spark):
    rows = docs_of(spark, [(1, "a"), (2, "a"), (2, "a"), (3, None)]).withColumn(
        "meta", F.when(F.col("doc_id") < 3, F.create_map(F.lit("k"), F.col("doc_id")))
    )
    kept = exact_dedup.keep_one(rows)
    assert kept.columns == rows.columns and kept.schema["meta"].dataType == rows.schema["meta"].dataType
    assert sorted((r.doc_id, r.text, r.meta) for r in kept.collect()) == [(2, "a", {"k": 2}), (3, None, None)]


def exact_plain_in(rows):
    """exact_plain in the order of sorted rows."""
    by = {(d, s): (d, k) for d, k, _, _, s in exact_plain(rows)}
    return [by[d, hashlib.sha256((t or "").encode()).hexdigest()] for d, t in sorted(rows, key=repr)]


def lines_plain(rows, min_docs, min_chars):
    def key(line):
        return lower_ascii(line.strip(" \t\n\x0b\f\r"))

    texts = [(t or "").split("\n") for _, t in rows]
    often = Counter(k for lines in texts for k in {key(x) for x in lines})
    out = []
    for (doc_id, _), lines in zip(rows, texts):
        kept = [x for x in lines if len(key(x)) < min_chars or often[key(x)] < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 1), (10, 0), (3, 5)])
def test_line_dedup(spark, min_docs, min_chars):
    for rows in (awkward(), []):
        found = line_dedup.dedup_lines(docs_of(spark, rows), min_docs, min_chars)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == lines_plain(rows, min_docs, min_chars)
