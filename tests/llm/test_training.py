"""Packing, the quality classifier, the queries and the pipeline."""

import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from compare import connect, duck_rows, spark_rows
from llm.cases import awkward, docs_of
from llm.test_duplicates import components, exact_plain
from llm.test_scans import contaminated_plain
from sendledger.llm import packing, quality
from sendledger.llm.queries import ORACLES, QUERIES
from sendledger.llm.weak import ABSTAIN, Reliabilities

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_names, expected = duck_rows(connect(SF_DIR), ORACLES[name])
    assert names == expected_names
    assert rows == expected


def check_packed(pieces, texts, tokenizer, window=2048):
    """Each id lies in one piece, checksums agree, sequences are full and gapless. Gives the ids of each sequence."""
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length, p.queue))
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(own.tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    assert set(by_doc) == set(ids)
    for spans, every in ((by_doc.values(), None), (by_sequence.values(), window)):
        for found in spans:
            at = 0
            for start, length, *_ in sorted(found):
                assert start == at and length > 0
                at += length
            assert every is None or at <= every
    for d, found in by_doc.items():
        assert sum(n for _, n in found) == len(ids[d])
    sizes = {s: sum(n for _, n, _ in found) for s, found in by_sequence.items()}
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == window for s, n in sizes.items() if s < len(sizes) - 1)
    return by_sequence


def test_packing(spark, tokenizer):
    rows = [(i, t) for k, (i, t) in enumerate(awkward()) if i is not None and i not in (12, 13)]
    rows += [(900, "<|endoftext|> in it"), (901, "\x02 odd \x02\x02 marks"), (902, "A\tB\u00a0c  d"), *enumerate(ODD_TEXTS, 910)]
    pieces = packing.pack(docs_of(spark, rows)).collect()
    check_packed(pieces, dict(rows), tokenizer)
    assert packing.pack(docs_of(spark, [])).collect() == []


ODD_TEXTS = ["SABR\u0130, AL\u0130.", "\u095c, x", "\ufb2a. y", "J\u030c H\u0331 I\u0323\u0307", "\u0939\u093f\u0928\u094d\u0926\u0940, \u092d\u093e\u0937\u093e."]


def test_ids_are_the_tokenizers(tokenizer):
    """Odd letters before signs, and random texts over the first planes, against the plain tokenizer."""
    rng = random.Random(11)
    every = [chr(c) for c in range(32, 0x3000)]
    pools = [every, [c for c in every if c.isalpha()], list("abcI\u0130i\u00e9\u00df\u03a3\u03c3'.,;:! \n\t12"), [chr(c) for c in range(0x300, 0x370)]]
    texts = ODD_TEXTS + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 14))) + rng.choice(["", ",", "."]) for _ in range(8000)]
    encoder = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    got = [ids.tolist() for some in encoder.encode(pa.array(texts, pa.string())) for ids in some]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_keeps_repeated_rows(spark):
    rows = awkward()
    pieces = packing.pack(docs_of(spark, rows)).collect()
    starts = Counter(p.doc_id for p in pieces if p.start == 0)
    assert starts == Counter(i for i, _ in rows)


def test_packing_mixture(spark, tokenizer):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn(
        "source", F.concat(F.lit("s"), F.pmod(F.col("doc_id"), F.lit(3)))
    )
    weights = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    pieces = packing.pack(docs, weights=weights).collect()
    sequences = check_packed(pieces, {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    totals = Counter()
    for p in pieces:
        totals[p.queue] += p.length
    rounds = min(totals[s] / w for s, w in weights.items()) / 2048  # until the first queue runs dry
    for s in range(int(rounds) - 1):
        share = Counter()
        for _, n, queue in sequences[s]:
            share[queue] += n
        assert all(abs(share[q] - w * 2048) <= 3 for q, w in weights.items())


def test_packing_with_many_sources(spark, tokenizer):
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(200)]
    docs = docs_of(spark, rows).withColumn("source", F.concat(F.lit("site"), F.col("doc_id")))
    pieces = packing.pack(docs, max_queues=8, window=64).collect()
    check_packed(pieces, dict(rows), tokenizer, 64)
    assert len({p.queue for p in pieces}) <= 8


def round_robin(pieces, weights, window):
    """The runs of each sequence, served round by round: a plain version over the queues' totals."""
    totals = Counter()
    for p in pieces:
        totals[p.queue] += p.length
    # null sorts first, then by name
    names = sorted(totals, key=lambda q: (q is not None, q or ""))
    shares = {q: (weights or totals).get(q, 0) for q in names}
    quanta = {q: max(1, round(shares[q] / sum(shares.values()) * window * 65536)) for q in names}
    stream, served, r = [], Counter(), 0
    while sum(served.values()) < sum(totals.values()):
        r += 1
        for q in names:
            due = min(totals[q], quanta[q] * r >> 16)
            stream += [q] * (due - served[q])
            served[q] = due
    return stream


def queue_stream(pieces):
    return [p.queue for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) for _ in range(p.length)]


def test_packing_keeps_each_source_a_queue(spark, tokenizer):
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(300)]
    site = F.pmod(F.col("doc_id"), F.lit(90))
    docs = docs_of(spark, rows).withColumn("source", F.when(site == 1, F.lit("")).when(site > 1, F.concat(F.lit("site"), site)))
    weights = {"site7": 0.5, "site8": 0.25, "site9": 0.25, **{f"site{k}": 0.01 for k in range(10, 40)}}
    for given in (None, weights):
        pieces = packing.pack(docs, weights=given, window=64).collect()
        check_packed(pieces, dict(rows), tokenizer, 64)
        assert len({p.queue for p in pieces}) == 90 and {None, ""} < {p.queue for p in pieces}
        assert queue_stream(pieces) == round_robin(pieces, given, 64)



def test_reliabilities_are_recovered():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.3
    rates = [(0.9, 0.05), (0.7, 0.1), (0.8, 0.2), (0.6, 0.02)]  # yes given yes, yes given no
    cast = np.stack([np.where(truth, rng.random(len(truth)) < a, rng.random(len(truth)) < b) for a, b in rates], 1).astype(int)
    cast[rng.random(cast.shape) < 0.2] = ABSTAIN
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    fitted = Reliabilities(4, 1).fit(patterns, np.zeros(len(patterns), int), counts.astype(float))
    for k, (a, b) in enumerate(rates):
        assert abs(fitted.theta[k][1, 1] - 0.8 * a) < 0.03 and abs(fitted.theta[k][0, 1] - 0.8 * b) < 0.03
    assert abs(fitted.prior[0] - 0.3) < 0.02


@pytest.fixture(scope="module")
def middle(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_quality_on_held_out_labels(spark, middle):
    docs, labels = middle
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    scored = quality.score_documents(docs, labels.where(~held))
    rows = scored.join(labels.where(held), "doc_id").select("quality", labels["toxic"].alias("is_toxic"), "kept").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.is_toxic]
    junk = [not r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(junk) >= 0.95 * len(junk)


def test_toxic_is_found_in_each_language(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    wanted = labels.where(held & (F.col("quality") == 1)).select("doc_id", F.col("toxic").alias("is_toxic"))
    scored = quality.score_documents(docs, labels.where(~held)).join(wanted, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rejected = defaultdict(list)
    for r in scored.collect():
        rejected[r.lang, r.is_toxic].append(r.toxic >= 0.5)
    assert {lang for lang, toxic in rejected if toxic} == {"en", "de", "fr", "es"}
    for (_, toxic), found in rejected.items():
        assert sum(found) >= 0.85 * len(found) if toxic else sum(found) <= 0.05 * len(found)


def test_a_rare_class_is_learned_within_the_bounds(spark):
    """16 toxic labels among 300, and 500 labels that name no document."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 40)) for _ in range(900)]
    rows = [(i, f"zorgnat {t} plimfox" if i % 37 == 0 else t) for i, t in enumerate(texts)]  # 25 toxic
    labels = [(i, 1, int(i % 37 == 0)) for i in range(900) if i % 37 == 0 and i < 16 * 37 or i % 3 == 1 and i % 37]
    labels += [(i, 1, 0) for i in range(10_000, 10_500)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = quality.score_documents(docs_of(spark, rows), labels, max_labelled=60, max_training=90).collect()
    unseen = [r.toxic >= 0.5 for r in scored if r.doc_id % 37 == 0 and r.doc_id >= 16 * 37]
    assert len(unseen) == 9 and all(unseen)
    assert sum(r.toxic >= 0.5 for r in scored if r.doc_id % 37) <= 9


def test_insults_are_rejected_without_labels(spark, middle):
    docs, labels = middle
    scored = {r.doc_id: r.kept for r in quality.score_documents(docs, labels.limit(0)).collect()}
    insulted = [r.doc_id for r in docs.where(F.lower("text").rlike(r"\b(idiot|moron|pathetic|worthless)\b")).collect()]
    assert insulted and sum(not scored[i] for i in insulted) >= 0.9 * len(insulted)


def test_quality_awkward(spark):
    docs = docs_of(spark, awkward())
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (20, None, None), (20, 1, 0), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs, labels).count() == len(awkward())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(awkward())
    assert quality.score_documents(docs.limit(0), labels).collect() == []
    assert quality.keep_good(docs.limit(0), labels.limit(0)).collect() == []


def test_pipeline_stages(spark, tokenizer, tmp_path):
    """Each stage against a plain version on what its predecessor kept."""
    docs = corpus_pipeline.table(spark, SF_DIR, "documents")
    con = duckdb.connect()
    items = con.execute(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    columns, name_of = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF_DIR)
        if name == "quality_classifier":
            labels = corpus_pipeline.table(spark, SF_DIR, "labels")
            kept = {r.doc_id for r in quality.score_documents(docs, labels).where("kept").collect()}
        elif name == "exact_dedup":
            kept = {k for _, k, *_ in exact_plain(before)}
        elif name == "ngram_jaccard_join":
            kept = {c for _, _, c in components(before)}
        elif name == "benchmark_decontamination":
            kept = {d for d, n, h, _ in contaminated_plain(before, items) if not (h and 20 * len(h) >= n)}
        else:
            check_packed(out.collect(), dict(before), tokenizer)
            continue
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name_of[k]))
        docs = spark.read.parquet(str(tmp_path / name_of[k]))
        assert sorted(r.doc_id for r in docs.collect()) == sorted(kept)
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
