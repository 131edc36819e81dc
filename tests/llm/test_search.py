"""Collocations, ranked search and main text against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.cases import awkward, docs_of, lower_ascii
from sendledger.llm import collocations, lexical, main_text

LOREM = "the of and to in is it that for on was as with be by at from this have or".split()


def phrasey(seed: int, n: int = 150) -> list[tuple]:
    """Texts over few words, so that phrases repeat; signs between some words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(LOREM[: rng.choice((4, 20))]) for _ in range(rng.randrange(0, 60))]
        text = "".join(w.upper() if rng.random() < 0.1 else w for w in [w + rng.choice([" "] * 9 + [", ", ".", "\t", "\n", " - "]) for w in words])
        rows.append((1000 + i, text + rng.choice(["", "New York City hall "] * 2)))
    return rows


def collocations_plain(rows, min_count, longest, share, top):
    """rows of (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower_ascii(text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = [p for p in f if len(p) > 1 and f[p] >= min_count]
        hidden = set()
        for p in found:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * f[p] >= share * f[p[i : i + size]]:
                        hidden.add(p[i : i + size])
        ranked = []
        for p in set(found) - hidden:
            score, k = min((2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def mined(docs, **given):
    return sorted(tuple(r) for r in collocations.collocations(docs, filter_bits=2**20, **given).collect())


@pytest.mark.parametrize("shard", [8_000_000, 500])
def test_collocations(spark, monkeypatch, shard):
    rows = awkward() + phrasey(1)
    docs = docs_of(spark, rows)
    monkeypatch.setattr(collocations, "_SHARD", shard)
    plain = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    for given in ({"min_count": 30, "longest": 4, "share": 80, "top": 2000}, {"min_count": 3, "longest": 5, "share": 60, "top": 40}):
        expected = collocations_plain(plain, **given)
        assert expected and mined(docs, **given) == expected


def test_collocations_with_a_full_bitmap(spark):
    """A bitmap that lets every pair through costs work only."""
    docs = docs_of(spark, phrasey(2, 60))
    plain = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    found = collocations.collocations(docs, min_count=4, filter_bits=32768)
    assert sorted(map(tuple, found.collect())) == collocations_plain(plain, 4, 4, 80, 2000)


def test_three_and_four_words_are_counted_in_one_pass(spark, monkeypatch):
    """The texts are read for words, pairs, and triples with what is one word longer; two more lengths take one pass more."""
    docs, read, over_shards = docs_of(spark, phrasey(4, 40)), [], collocations._over_shards
    monkeypatch.setattr(collocations, "_over_shards", lambda docs, each, schema: read.append(schema) or over_shards(docs, each, schema))
    plain = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    for longest, passes in ((2, 2), (3, 3), (4, 3), (6, 4)):
        read.clear()
        assert mined(docs, min_count=4, longest=longest) == collocations_plain(plain, 4, longest, 80, 2000) != []
        assert len(read) == passes


def test_counts_of_phrases_are_not_broadcast(spark):
    """Their files look small, as they are compressed and hold each row once for all salts."""
    docs = docs_of(spark, phrasey(4, 40))
    words = collocations.stored(collocations.word_counts(docs))
    pairs = words.select(F.array(F.xxhash64("lang", "phrase")).alias("ws"), "f")
    pairs = collocations.stored(pairs.select(F.col("ws")[0].alias("w1"), F.col("ws")[0].alias("w2"), "f"))
    plans = [
        collocations._spelled([pairs], words),
        collocations._salted_join(words.select("lang", F.col("phrase").alias("first"), F.lit(0).alias("salt")), words, "first", "l"),
        collocations.collocations(docs, min_count=4, filter_bits=2**20),
    ]
    joins = [re.findall("SortMergeJoin|BroadcastHashJoin", p._jdf.queryExecution().executedPlan().toString()) for p in plans]
    assert joins[0] == joins[1] == ["SortMergeJoin"]
    assert joins[2].count("SortMergeJoin") == 3 and joins[2].count("BroadcastHashJoin") <= 1  # the totals, a row a language


def test_collocations_of_nothing(spark):
    assert mined(docs_of(spark, [])) == []
    assert mined(docs_of(spark, [(1, None), (2, " ,. ")])) == []


def test_phrases_are_intervals_of_both_transforms():
    rng = random.Random(3)
    text = np.array([rng.randrange(0, 6) for _ in range(500)] + [0])
    expected = Counter(
        tuple(text[i : i + n]) for n in (2, 3, 4) for i in range(len(text) - n + 1) if 0 not in text[i : i + n]
    )
    got = Counter()
    for rows, size in collocations.phrases(text, 6, 4):
        got.update({tuple(r): int(s) for r, s in zip(rows, size)})
    assert got == expected


def test_words_hash_as_in_spark(spark):
    """The bitmaps are made by Spark and read in the shards."""
    shard = collocations.Shard("de", ["Straße und Ärger, 日本 und x"])
    rows = spark.createDataFrame([("de", w.decode()) for w in shard.names[1:]], "lang string, phrase string")
    made = [r.hash % 2**64 for r in rows.select(F.xxhash64("lang", "phrase").alias("hash")).collect()]
    assert made == shard.hashes()[1:].tolist()
    three = np.stack([shard.hashes()[1:][[0, 1, 2]], shard.hashes()[1:][[2, 0, 1]]])
    rows = spark.createDataFrame([tuple(r) for r in three.view(np.int64).tolist()], "a long, b long, c long")
    assert [r[0] % 2**64 for r in rows.select(F.xxhash64("a", "b", "c")).collect()] == collocations.phrase_hash(three).tolist()


def search_plain(docs, items, k):
    terms = [(d, re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower_ascii(t or ""))) for d, t in docs]
    terms = [(d, Counter(w), len(w)) for d, w in terms if w]
    total, n = sum(s for *_, s in terms), len(terms)
    df = Counter(w for _, c, _ in terms for w in c)
    out = []
    for item, text in items:
        asked = Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower_ascii(text or "")))
        scored = []
        for d, c, size in terms:
            m = 75 + 25 * size * n // total
            score = sum(
                t * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m))
                for w, t in asked.items() if w in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, rank int, term string").repartition(2)


def test_search(spark, monkeypatch):
    rows = awkward() + phrasey(4, 60)
    rng = random.Random(5)
    items = [(i, " ".join(rng.sample(" ".join(t for _, t in rows if t and len(t) < 9000).split(), rng.randrange(1, 90)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere-to-be-found"), (53, "the the THE of"), (None, "w1 w2 w3"), (54, rows[30][1]), (54, rows[30][1])]
    docs = docs_of(spark, rows)
    for block, first, k, bound in ((2048, 64, 20, 200_000), (16, 2, 3, 200_000), (32, 4, 20, 400)):
        monkeypatch.setattr(lexical, "_BLOCK", block)
        monkeypatch.setattr(lexical, "_FIRST", first)
        found = lexical.search(docs, items_of(spark, items), k=k, max_terms=bound)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == search_plain(rows, items, k)


def test_search_of_nothing(spark):
    some = items_of(spark, [(1, "a b")])
    assert lexical.search(docs_of(spark, []), some).collect() == []
    assert lexical.search(docs_of(spark, [(1, "a")]), items_of(spark, [])).collect() == []
    assert lexical.search(docs_of(spark, [(1, None), (2, " - ")]), some).collect() == []


def test_masks_are_left_when_none_can_win(spark, monkeypatch):
    """Documents with the best mask come first, and most masks are never evaluated."""
    rows = [(i, "rare words here" if i % 50 == 0 else "common filler of no use, rare") for i in range(500)]
    looked = []
    scores = lexical.Block._scores

    def counted(self, docs, weight_of):
        looked.append(len(docs))
        return scores(self, docs, weight_of)

    monkeypatch.setattr(lexical.Block, "_scores", counted)
    numbers = {w: i for i, w in enumerate("rare words here".split())}
    packed = [[numbers[w] for w in re.findall("[a-z]+", t) if w in numbers] for _, t in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows]), pa.array([len(t.split()) for _, t in rows]),
         pa.array([np.array(p, np.int32).tobytes() for p in packed], pa.binary()),
         pa.array([np.ones(len(p), np.int64).tobytes() for p in packed], pa.binary())],
        ["doc_id", "n", "numbers", "counts"],
    )
    queries = lexical.Queries([], len(rows), sum(len(t.split()) for _, t in rows), 5)
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    best = lexical.Block(batch, queries).rank(np.arange(3), np.array([100, 3000, 3000]), none, 5)
    assert best[1].tolist() == [0, 50, 100, 150, 200] and sum(looked) == 64


def pages_of(spark, rows):
    schema = "page_id long, url string, html string, main string, blocks string, host string, shard long, text string"
    return spark.createDataFrame([(*r, *["x"] * 3, 1, "x") for r in rows], schema).repartition(3)


SHAPES = [
    ('<div class="with-sidebar"><article><h1>T</h1><p>a<p>b</article></div><div id="comments"><article class="comment">c</article><article>d</article></div>', "T\na\nb"),
    ('<header><h1>Site</h1></header><article class="post category-notice"><header><h1>Head</h1><p>by X</header><p>x <b>y</p><p>z</b>w'
     '<aside>side</aside><div class="share-buttons">s</div><form>f</form></article><footer>f</footer>', "Head\nx y\nzw"),
    ("<article>x &lt;p&gt; &amp;amp; &#8217;\n\t y<br>z<!-- no --><script>var t = '</p>'</script> &amp</article>", "x <p> &amp; \u2019 y z &"),
    ("<main><ul><li>one<li>two <i>2</i></ul><table><tr><td>a<td>b<tr><td>c</table></main><p>out", "one\ntwo 2\na b\nc"),
    ('<div class="content"><p>A</p><div class="cookie-notice">no</div></div><div class="sidebar">B', "A"),
    ("<article>open <b>to the end", "open to the end"),
    ("<article>cut <!-- off", "cut"),
    ("<article>cut <a href=\"off", "cut"),
    ("<nav>only a menu</nav>", ""),
    ("", ""),
    (None, ""),
]


def test_labelled_pages(spark):
    rows = [(i, f"http://h{i}.example.com/x", html) for i, (html, _) in enumerate(SHAPES)] + [(77, None, SHAPES[0][0])] * 2
    found = main_text.extract(pages_of(spark, rows))
    assert found.columns == ["page_id", "url", "text", "n_chars", "n_boilerplate"]
    texts = sorted((r.page_id, r.text, r.n_chars) for r in found.collect())
    expected = [(i, text) for i, (_, text) in enumerate(SHAPES)] + [(77, SHAPES[0][1])] * 2
    assert texts == sorted((i, t, len(t)) for i, t in expected)
    assert main_text.extract(pages_of(spark, [])).collect() == []


def test_long_pages_are_read_once():
    for part in ("<", "<p ", '<p a="', "<li>", "<b><p>", "<!--", "<title>", "</b>", "<a b='", "&amp", '<div class="ad"><article>'):
        main_text.blocks_of(part * 30_000)


def repeats_plain(streams, width, min_pages):
    """Which tokens of each stream (of one host) stand in a run that min_pages distinct streams hold."""
    def runs(tokens):
        size = min(width, len(tokens))
        return [(i, tuple(tokens[i : i + size])) for i in range(len(tokens) - size + 1)] if size else []

    held = Counter(run for tokens in set(map(tuple, streams)) for run in {r for _, r in runs(tokens)})
    marks = []
    for tokens in streams:
        own = [False] * len(tokens)
        for i, run in runs(tokens):
            if held[run] >= min_pages:
                own[i : i + len(run)] = [True] * len(run)
        marks.append(own)
    return marks


@pytest.mark.parametrize("shard_tokens", [500_000, 300])
def test_repeated_substrings_are_boilerplate(spark, shard_tokens):
    """Pages without labels, on a large and a small host, against a plain count of runs."""
    rng = random.Random(9)
    menu, note = [f"<div>menu item {k}</div>" for k in range(6)], "<p>please read our notice on how we use your data here</p>"
    rows = []
    for i in range(90):
        host = "big.example.com" if i % 3 else f"small{i % 4}.example.com"
        body = [f"<p>{' '.join(rng.choice('abcdefgh') * 3 + str(rng.randrange(300)) for _ in range(rng.randrange(3, 40)))}</p>" for _ in range(3)]
        body[1:1] = [note] if rng.random() < 0.6 else []
        rows.append((i, f"https://{host}/p{i}", "".join(menu[: rng.randrange(4, 7)] + body + ["<footer>imprint</footer>"])))
    rows += [(200 + i, "https://big.example.com/copy", rows[1][2]) for i in range(5)]  # copies count once
    by_host = defaultdict(list)
    for i, url, page in rows:
        by_host[url.split("/")[2]].append((i, main_text.blocks_of(page)))
    expected = []
    for found in by_host.values():
        streams = [[t for text, _, _ in blocks for t in text.split(" ")] for _, blocks in found]
        for (i, blocks), marks in zip(found, repeats_plain(streams, 8, 3)):
            kept, at = [], 0
            for text, other, _ in blocks:
                size = text.count(" ") + 1
                if not other and 2 * sum(marks[at : at + size]) < size:
                    kept.append(text)
                at += size
            expected.append((i, "\n".join(kept)))
    found = main_text.extract(pages_of(spark, rows), shard_tokens=shard_tokens)
    assert sorted((r.page_id, r.text) for r in found.collect()) == sorted(expected)
    texts = dict(expected)
    large = [texts[i] for i, url, _ in rows if "big" in url]
    assert any("notice" in p for _, _, p in rows) and not any("notice" in t or "menu" in t for t in large)
    assert all(texts[200 + i] == texts[1] != "" for i in range(5))


def test_menus_of_articles_are_found_by_repetition(spark):
    """The repeated blocks outside the article are counted; the article keeps a passage that all pages share."""
    menu, passage = "<nav><ul><li>home</li><li>about us and more</li><li>contact the authors</li></ul></nav>", "a passage that every one of these articles holds"
    rows = [(i, "https://a.example.com/", f"{menu}<article><p>text {i}</p><p>{passage}</p></article>") for i in range(4)]
    found = main_text.extract(pages_of(spark, rows + [(9, "https://b.example.com/", rows[0][2])]), min_pages=1).collect()
    assert {(r.page_id, r.text, r.n_boilerplate) for r in found} == {
        *[(i, f"text {i}\n{passage}", 3) for i in range(4)], (9, f"text 0\n{passage}", 3),
    }
    found = main_text.extract(pages_of(spark, rows), min_pages=2).collect()
    assert {r.n_boilerplate for r in found} == {0}  # the four streams are the same


def test_pages_with_articles_tell_what_their_host_repeats(spark):
    """Pages that differ in their articles alone are different pages; what they repeat goes from a page without a label."""
    menu = ["home", "about us and more", "contact the authors"]
    nav = f"<nav><ul>{''.join(f'<li>{m}</li>' for m in menu)}</ul></nav>"
    bare = "".join(f"<div>{m}</div>" for m in menu)
    rows = []
    for host, urls, texts in (("a", "wxyz", "1234"), ("copies", "wxyz", "1111"), ("once", "wwww", "1234"), ("few", "w", "1")):
        rows += [(len(rows) + i, f"https://{host}.example.com/{u}", f"{nav}<article><p>text {t}</p></article>") for i, (u, t) in enumerate(zip(urls, texts))]
        rows.append((len(rows) + 100, f"https://{host}.example.com/bare", f"{bare}<p>words of its own</p>"))
    rows += [(300 + i, None, f"{nav}<article><p>text {i}</p></article>") for i in range(4)] + [(400, None, f"{bare}<p>words of its own</p>")]
    found = main_text.extract(pages_of(spark, rows)).collect()
    texts = {r.url or "null": r.text for r in found if r.page_id >= 100 and "text" not in r.text}
    whole = "\n".join([*menu, "words of its own"])
    assert texts == {
        "https://a.example.com/bare": "words of its own", "null": "words of its own",
        **{f"https://{host}.example.com/bare": whole for host in ("copies", "once", "few")},
    }
    assert all(r.n_boilerplate == (3 if r.url is None or "//a." in r.url else 0) for r in found)
    assert sorted(r.text for r in found if r.page_id < 100 and "//a." in r.url) == [f"text {i}" for i in range(1, 5)]


def test_main_text_around_an_article_is_judged(spark):
    """Blocks of a weaker label than the article's are in the stream too."""
    notice = "please read our notice on how we use your data here"
    rows = [(i, f"https://a.example.com/{i}", f"<main><p>{notice}</p><article><p>text {i}</p></article></main>") for i in range(3)]
    rows.append((9, "https://a.example.com/9", f"<p>{notice}</p><p>words of its own</p>"))
    found = {r.page_id: (r.text, r.n_boilerplate) for r in main_text.extract(pages_of(spark, rows)).collect()}
    assert found == {**{i: (f"text {i}", 1) for i in range(3)}, 9: ("words of its own", 1)}


@pytest.mark.parametrize("shard_tokens, bits", [(500_000, 2**26), (60, 2**26), (60, 2**15)])
def test_articles_are_in_the_suffix_array(spark, monkeypatch, shard_tokens, bits):
    """What the articles of several pages hold is boilerplate on a page without a label; the articles keep it."""
    monkeypatch.setattr(main_text, "_FILTER_BITS", bits)
    held = [f"this is passage {k} as it stands on page after page" for k in range(4)]
    pages = [  # url, passages of the article, passages outside
        *[(f"a{i}", [0], []) for i in range(2)],  # with the page without a label, on three
        *[(f"b{i}", [1], []) for i in range(3)], *[("again", [1, 2], [i]) for i in (7, 8, 9)],  # a url that was read three times counts once
        ("c", [3], [3]),  # twice on one page
    ]
    rows = [
        (i, f"https://h.example.com/{url}", f"<article>{''.join(f'<p>{held[k]}</p>' for k in own)}<p>text {i}</p></article>"
         + "".join(f"<p>{held[k] if k < 4 else f'note {k}'}</p>" for k in outside))
        for i, (url, own, outside) in enumerate(pages)
    ]
    rows += [(50 + i, "https://h.example.com/copy", rows[0][2]) for i in range(3)]  # copies of a page count once
    rows.append((99, "https://h.example.com/bare", "".join(f"<div>{p}</div>" for p in held) + "<p>words of its own</p>"))
    found = {r.page_id: r for r in main_text.extract(pages_of(spark, rows), shard_tokens=shard_tokens).collect()}
    assert found[99].text == "\n".join([held[2], held[3], "words of its own"]) and found[99].n_boilerplate == 2
    assert all(found[i].text == "\n".join([*[held[k] for k in own], f"text {i}"]) for i, (_, own, _) in enumerate(pages))
    assert all(found[50 + i].text == found[0].text for i in range(3)) and {found[i].n_boilerplate for i in range(9)} == {0}


@pytest.mark.parametrize("shard_tokens", [500_000, 300])
def test_substrings_are_counted_over_articles_and_the_rest(spark, shard_tokens):
    """Pages with and without articles against a plain count of the distinct pages of each run."""
    rng = random.Random(12)
    shared = [" ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(40)) for _ in range(rng.randrange(4, 30))) for _ in range(25)]

    def passages(n):
        own = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(2, 20))) for _ in range(n)]
        return [rng.choice(shared) if rng.random() < 0.5 else p for p in own]

    rows = []
    for i in range(80):
        rest, article = passages(rng.randrange(0, 4)), passages(rng.randrange(1, 4)) if rng.random() < 0.6 else []
        html = "".join(f"<p>{p}</p>" for p in rest) + ("<article>" + "".join(f"<p>{p}</p>" for p in article) + "</article>" if article else "")
        rows.append((i, f"https://{'one' if i % 4 else 'two'}.example.com/{i if rng.random() < 0.8 else 'x'}", html))
    held, parts = defaultdict(set), {}
    for i, url, page in rows:
        parts[i] = main_text.split(main_text.blocks_of(page))
        for texts in parts[i]:
            tokens = " ".join(texts).split()
            size = min(8, len(tokens))
            for at in range(len(tokens) - size + 1 if size else 0):
                held[url.split("/")[2], *tokens[at : at + size]].add(url)
    expected = {}
    for i, url, _ in rows:
        rest, article = parts[i]
        tokens = " ".join(rest).split()
        size, marks = min(8, len(tokens)), [False] * len(tokens)
        for at in range(len(tokens) - size + 1 if size else 0):
            if len(held[url.split("/")[2], *tokens[at : at + size]]) >= 3:
                marks[at : at + size] = [True] * size
        kept, at, repeats = [], 0, 0
        for text in rest:
            n = len(text.split())
            boring = 2 * sum(marks[at : at + n]) >= n
            repeats, at = repeats + boring, at + n
            kept += [] if boring else [text]
        expected[i] = ("\n".join(article or kept), repeats)
    found = {r.page_id: (r.text, r.n_boilerplate) for r in main_text.extract(pages_of(spark, rows), shard_tokens=shard_tokens).collect()}
    assert found == expected and sum(n for _, n in expected.values()) > 20
