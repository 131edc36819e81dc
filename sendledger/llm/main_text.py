"""The main text of web pages: a suffix array of each host's token streams, and what the markup says.

A page is parsed into blocks of text. Markup may label a block as part of the article (``article``, then
``main``, then class names) or as something else (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments). Every block goes into one of the page's two token streams: that of its labelled article, or that of
all the rest (the whole page, if nothing is labelled as main text).
Both streams of a host's pages, shard by shard, are concatenated and their suffixes sorted by the first ``width`` tokens;
equal neighbours are long repeated substrings, and the distinct pages that hold each, in whichever stream, are counted and summed
over the host's shards. Blocks outside the article at least half covered by substrings of ``min_pages`` or more pages are
boilerplate (``n_boilerplate`` of each page) and go; the unique runs stay, unless the markup labels them as something else or
the page has a labelled article.

The article's own blocks are not put to the test of repetition: articles share passages, or are copies, and those
are to stay whole. What they repeat counts all the same: a passage in the articles of several pages is boilerplate on a page
of the host without a label. A page counts once for all places that a substring has in it. Copies of a page count as one
page, and so does a url that was read several times; a page without ``url`` is known by its text.

Only substrings that some page holds outside its article are judged, so the others are not listed by the shards. Those are
known by a bitmap of fixed size (``_FILTER_BITS``) over the hashes of all substrings outside articles: it may
let others through, which costs work but no result.

Parameters: ``width`` tokens, ``min_pages``, ``shard_tokens`` (a host's pages are dealt over as many shards as that
needs, by a hash of their streams, and a shard with many copies over several groups, so that no task holds a whole
large host or all copies of a page).

Defined results: a null or empty page has an empty text. A page without ``url`` belongs to an empty host. Repeated rows
are extracted each. Unclosed elements end with their parent, an unclosed comment, script or tag runs to the end of
the page. Long pages are read whole, in time linear in their length. An empty table gives an empty result; other
columns are ignored. The pages are parsed three times, as their texts are not written in between.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sendledger.llm.common import bitmap, inside, pieces, stored

WIDTH = 8
MIN_PAGES = 3
SHARD_TOKENS = 500_000
_FILTER_BITS = 2**26

# Elements, and words of class, id and role, by what they stand for.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody tfoot thead tr ul".split()
)
_OTHER = frozenset("head nav footer aside form button select datalist dialog menu template noscript svg math object".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OTHER_WORDS = frozenset(
    "ad ads advert adverts advertising advertisement adsense sponsor sponsors sponsored promo promos promotion banner "
    "banners cookie cookies consent gdpr notice notices alert popup modal overlay paywall nav navbar navigation menu "
    "menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead topbar toolbar comment "
    "comments commentlist reply replies respond disqus social share sharing related recommended recommendations "
    "newsletter subscribe subscription signup login search searchform pagination pager complementary contentinfo".split()
)
_MAIN_WORDS = frozenset("article story post entry content".split())
_SAYS_LITTLE = frozenset("no has with without hide show is category tag type status format".split())
_CLOSES = {  # an element that opens closes these where they stand open inside the nearest of the others
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+)>"""
)
_ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
_WORD = re.compile("[a-z]+")
_CAMEL = re.compile("([a-z])([A-Z])")
ARTICLE, MAIN, CLASS = 3, 2, 1  # labels of main text, the strongest first
_FIRM, _NAMED, _HEADER = "element", "class", "header of an article"


def _kind(name: str, attributes: str) -> tuple[int, bool]:
    """What an element's name and attributes say: its label of main text (0: none), whether it is something else.

    A class or id is named after something else if its first or last word is.
    """
    label, other = {"article": ARTICLE, "main": MAIN}.get(name, 0), False
    if "=" not in attributes or name in ("html", "body"):
        return label, False
    for attribute, value in _ATTRIBUTE.findall(attributes):
        for one in value.strip("\"'").split():
            words = _WORD.findall(_CAMEL.sub(r"\1 \2", one).lower())
            if not words or words[0] in _SAYS_LITTLE:
                continue
            if attribute.lower() in ("role", "itemprop") and words in (["article"], ["article", "body"], ["articlebody"], ["main"]):
                label = max(label, MAIN if words == ["main"] else ARTICLE)
            elif words[0] in _OTHER_WORDS or words[-1] in _OTHER_WORDS:
                other = True
            elif words[-1] in _MAIN_WORDS and name in ("div", "section", "td"):
                label = max(label, CLASS)
    return (0 if other and name != "main" else label), other and name != "main"


class _Page:
    """The blocks of a page, as its markup is read."""

    def __init__(self):
        self.blocks: list[tuple[str, int, int]] = []  # text, region, label
        self.run: list[str] = []  # text of the block under way
        self.open: list[tuple[str, int, int]] = [("", -1, 0)]  # open elements: name, region, label
        self.at: dict[str, list[int]] = {}  # where the elements of a name stand open
        self.block_at: list[int] = [0]  # where blocks stand open
        self.regions: list[tuple[str, int]] = []  # something else than main text: why, and the region around it
        self.wrapping: set[int] = set()  # regions by name that hold a labelled article

    def text(self, raw: str) -> None:
        if raw:
            self.run.append(references.unescape(raw))

    def end_block(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.blocks.append((text, *self.open[-1][1:]))
            self.run = []

    def _close(self, index: int) -> None:
        """Close the open elements from ``index`` on."""
        if self.block_at[-1] >= index:
            self.end_block()
        while self.block_at[-1] >= index:
            self.block_at.pop()
        while len(self.open) > index:
            self.at[self.open.pop()[0]].pop()

    def _last(self, names: tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def _region(self, why: str, around: int) -> int:
        self.regions.append((why, around))
        return len(self.regions) - 1

    def start(self, name: str, attributes: str) -> None:
        if name in _BLOCKS:
            if self.at.get("p"):
                self._close(self.at["p"][-1])
            self.end_block()
        elif name in ("br", "td", "th"):
            self.run.append(" ")
        if name in _CLOSES:
            closed, inside = _CLOSES[name]
            if (index := self._last(closed)) > self._last(inside):
                self._close(index)
        if name in _VOID:
            return
        _, region, label = self.open[-1]
        own, other = _kind(name, attributes)
        if own >= MAIN:
            around = region
            while around >= 0 and around not in self.wrapping:
                if self.regions[around][0] == _NAMED:
                    self.wrapping.add(around)
                around = self.regions[around][1]
        label = max(label, own)
        if name in _OTHER:
            region = self._region(_FIRM, region)
        elif name == "header":
            region = self._region(_HEADER if label >= MAIN else _FIRM, region)
        elif name in _HEADINGS and region >= 0 and self.regions[region][0] == _HEADER:
            region = self.regions[region][1]  # the headline stays
        elif other:
            region = self._region(_NAMED, region)
        self.at.setdefault(name, []).append(len(self.open))
        if name in _BLOCKS:
            self.block_at.append(len(self.open))
        self.open.append((name, region, label))

    def end(self, name: str) -> None:
        index = self._last((name,))
        if name in _BLOCKS:
            self._close(index) if index else self.end_block()
        elif index > self.block_at[-1]:  # else the element ends with the block that it spans
            self._close(index)

    def done(self) -> list[tuple[str, bool, int]]:
        self.end_block()

        def judged(wrappers_count: bool) -> list[tuple[str, bool, int]]:
            counts: list[bool] = []
            for k, (_, around) in enumerate(self.regions):
                counts.append(around >= 0 and counts[around] or wrappers_count or k not in self.wrapping)
            return [(text, region >= 0 and counts[region], label) for text, region, label in self.blocks]

        found = judged(True)
        if self.wrapping and not any(label >= MAIN and not other for _, other, label in found):
            return judged(False)  # named after a part of theirs, as "with sidebar"
        return found


def blocks_of(page: str | None) -> list[tuple[str, bool, int]]:
    """The blocks of a page in order: text, whether labelled as something else than main text, and its label of main text."""
    made, at, page = _Page(), 0, page or ""
    while (found := page.find("<", at)) >= 0:
        made.text(page[at:found])
        if page.startswith("<!--", found):
            stop = found + 4 if page.startswith((">", "->"), found + 4) else page.find("-->", found + 4)
            at = page.find(">", stop) + 1 if stop >= 0 else len(page)
        elif tag := _TAG.match(page, found):
            name, at = tag[2].lower(), tag.end()
            if tag[1]:
                made.end(name)
            else:
                made.start(name, tag[3])
                if name in _RAW:
                    close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                    at = close.start() if close else len(page)
        elif page[found + 1 : found + 2] in ("!", "?", "/") or page[found + 1 : found + 2].isalpha():
            # not a tag after all: runs to the next sign that ends one
            stop = page.find(">", found)
            at = stop + 1 if stop >= 0 else len(page)
        else:
            made.text("<")
            at = found + 1
        if at >= len(page):
            break
    else:
        made.text(page[at:])
    return made.done()


def strongest(blocks: list[tuple[str, bool, int]]) -> int:
    """The page's strongest label of main text; 0 if no block has one."""
    return max((label for _, other, label in blocks if not other), default=0)


def labelled(blocks: list[tuple[str, bool, int]]) -> str | None:
    """The blocks with the page's strongest label of main text, joined; None if no block has one."""
    best = strongest(blocks)
    if not best:
        return None
    return "\n".join(text for text, other, label in blocks if label >= best and not other)


def _host(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split("[/?#]", rest, maxsplit=1)[0].lower()


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) >> 1


def split(blocks: list[tuple[str, bool, int]]) -> tuple[list[str], list[str]]:
    """The texts outside the labelled article, and those of the article."""
    best = strongest(blocks)
    rest = [text for text, other, label in blocks if not best or other or label < best]
    return rest, [text for text, other, label in blocks if best and not other and label >= best]


def _stream(texts: list[str]) -> str | None:
    return " ".join(texts) or None


def _page_key(rest: list[str], article: list[str]) -> int:
    return _digest("\n".join(rest) + "\f" + "\n".join(article))


def _over_pages(pages: DataFrame, begin: Callable[[], Callable], schema: str, *others: str) -> DataFrame:
    """Rows of ``host``, ``page_key`` and ``schema``: ``begin()`` starts a task, and what it gives makes columns of some pages.

    That is called with their columns, their hosts, the texts outside and inside their articles, their keys and their blocks.
    """
    schema = f"host string, page_key long, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begin()
        for batch in pieces(batches, 500):
            blocks = [blocks_of(page) for page in batch.column("html").to_pylist()]
            parts = [split(b) for b in blocks]
            hosts = [_host(url) for url in batch.column("url").to_pylist()]
            columns = each(batch, hosts, parts, [_page_key(*p) for p in parts], blocks)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    texts = [F.col(name).cast("string").alias(name) for name in ("url", "html")]
    return pages.select(*others, *texts).mapInArrow(run, schema)


def keyed(pages: DataFrame, width: int) -> DataFrame:
    """(host, page_key, url_key, n_tokens, substrings): the hashes of the substrings outside articles, once for some pages."""

    def begin():
        def each(batch, hosts, parts, keys, blocks):
            urls = batch.column("url").to_pylist()
            rests = Streams([_stream(rest) for rest, _ in parts], width)
            at = np.flatnonzero(rests.length)
            value = rests.values(at)
            first = np.sort(np.unique(value, return_index=True)[1])
            begins = np.searchsorted(rests.owner[at[first]], np.arange(len(parts) + 1))
            return {
                "host": pa.array(hosts, pa.string()), "page_key": pa.array(keys, pa.int64()),
                "url_key": pa.array([_digest(url) if url else key for url, key in zip(urls, keys)], pa.int64()),
                "n_tokens": pa.array([sum(text.count(" ") + 1 for text, *_ in b) for b in blocks], pa.int64()),
                "substrings": pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(value[first], pa.int64())),
            }

        return each

    return _over_pages(pages, begin, "url_key long, n_tokens long, substrings array<long>")


def streamed(pages: DataFrame) -> DataFrame:
    """(host, page_key, rest, article): both streams of each page, once for its copies in a task."""

    def begin():
        seen = set()

        def each(batch, hosts, parts, keys, blocks):
            new = []
            for i, known in enumerate(zip(hosts, keys)):
                if known not in seen:
                    seen.add(known)
                    new.append(i)
            return {
                "host": pa.array([hosts[i] for i in new], pa.string()), "page_key": pa.array([keys[i] for i in new], pa.int64()),
                "rest": pa.array([_stream(parts[i][0]) for i in new], pa.string()),
                "article": pa.array([_stream(parts[i][1]) for i in new], pa.string()),
            }

        return each

    return _over_pages(pages, begin, "rest string, article string")


def parsed(pages: DataFrame) -> DataFrame:
    """(host, page_key, row, page_id, url, blocks, others, main).

    ``blocks`` and ``others`` (whether labelled as something else) are the texts outside the labelled article, ``main``
    is that article, or null.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def begin():
        row = TaskContext.get().partitionId() << 40

        def each(batch, hosts, parts, keys, blocks):
            nonlocal row
            others = []
            for found in blocks:
                best = strongest(found)
                others.append([other for _, other, label in found if not best or other or label < best])
            row += batch.num_rows
            return {
                "host": pa.array(hosts, pa.string()), "page_key": pa.array(keys, pa.int64()),
                "row": pa.array(np.arange(row - batch.num_rows, row)), "page_id": batch.column("page_id"), "url": batch.column("url"),
                "blocks": pa.array([rest for rest, _ in parts], pa.list_(pa.string())), "others": pa.array(others, pa.list_(pa.bool_())),
                "main": pa.array([labelled(b) for b in blocks], pa.string()),
            }

        return each

    return _over_pages(
        pages, begin, f"row long, page_id {kind}, url string, blocks array<string>, others array<boolean>, main string", "page_id"
    )


class Streams:
    """Token streams of one host, one after another, and their suffixes by the first ``width`` tokens."""

    def __init__(self, streams: list[str | None], width: int):
        self.width = width
        tokens = pc.split_pattern(pa.array(streams, pa.large_string()), " ")
        self.sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        self.hashes = np.array([xxhash.xxh64_intdigest(word) for word in words], np.uint64)[self.codes]
        self.owner = np.repeat(np.arange(len(streams)), self.sizes)
        self.place = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        # a suffix counts if it has ``width`` tokens, or is the whole of a shorter stream
        self.left = self.sizes[self.owner] - self.place
        self.length = np.where(self.left >= width, width, np.where(self.place == 0, self.left, 0))

    def values(self, at: np.ndarray) -> np.ndarray:
        """The hashes of the substrings that begin at these places."""
        value, length = np.zeros(len(at), np.uint64), self.length[at]
        for k in range(int(length.max(initial=0))):
            own = np.flatnonzero(length > k) if k >= length.min() else slice(None)
            value[own] = (value[own] + self.hashes[at[own] + k]) * np.uint64(0x9E3779B97F4A7C15)
            value[own] ^= value[own] >> np.uint64(31)
        return value.view(np.int64)

    def array(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the suffixes in order, and the rank of each; equal suffixes have one rank."""
        rank, known = self.codes + 1, 1
        while known < self.width and len(rank):  # by twice as many tokens each time; beyond a stream's end stands nothing
            if known > 1:
                rank = np.unique(rank, return_inverse=True)[1] + 1
            behind = np.zeros(len(rank), np.int64)
            if known < len(rank):
                behind[:-known] = np.where(self.left[:-known] > known, rank[known:], 0)
            rank = rank * (int(rank.max()) + 1) + behind
            known *= 2
        array = np.argsort(rank, kind="stable")
        array = array[self.length[array] > 0]
        return array, rank[array]

    def substrings(self, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash of each distinct substring; then pairs, each once, of a substring's number and a page that holds it.

        ``page`` is the page of each stream; those of one page follow each other.
        """
        array, rank = self.array()
        new = np.ones(len(rank), bool)
        new[1:] = rank[1:] != rank[:-1]
        number, page = np.cumsum(new) - 1, page[self.owner[array]]
        # equal suffixes stand in the order of their places, so those of one page are neighbours
        other = new.copy()
        other[1:] |= page[1:] != page[:-1]
        return self.values(array[new]), number[other], page[other]

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Which tokens stand inside an occurrence of one of the substrings with these hashes."""
        starts = np.flatnonzero(self.length)
        starts = starts[np.isin(self.values(starts), repeated)]
        edges = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + self.length[starts], -1)
        return np.cumsum(edges[:-1]) > 0


def _substrings(streams: DataFrame, several: DataFrame, width: int, judged) -> DataFrame:
    """(host, shard, hash, pages, owner): the substrings of each shard that the bitmap ``judged`` holds.

    ``pages`` counts pages with a url that was read once. ``several`` names the other pages' urls (``owner``), each of which has
    a row of its own, as it may stand in several shards.
    """

    def run(key, left, right):
        host, shard = (k.as_py() for k in key)
        keys, first = np.unique(left.column("page_key").to_numpy(), return_index=True)  # a page's copies are listed once
        left = left.take(pa.array(first))
        found = Streams([s for c in zip(left.column("rest").to_pylist(), left.column("article").to_pylist()) for s in c], width)
        value, number, page = found.substrings(np.arange(2 * len(keys)) // 2)
        listed = inside(judged.value, value.view(np.uint64))
        owner = np.zeros(len(keys), np.int64)
        often = np.isin(keys, named := right.column("page_key").to_numpy())
        owner[np.searchsorted(keys, named)] = right.column("owner").to_numpy()
        once = np.bincount(number[~often[page]], minlength=len(value))[listed]
        again = often[page] & listed[number]
        hashes = np.concatenate((value[listed], value[number[again]]))
        owners = pa.concat_arrays([pa.nulls(len(once), pa.int64()), pa.array(owner[page[again]])])
        return pa.table({
            "host": pa.array([host] * len(hashes), pa.string()), "shard": pa.array(np.full(len(hashes), shard, np.int64)),
            "hash": pa.array(hashes), "pages": pa.array(np.concatenate((once, np.zeros(again.sum(), np.int64)))), "owner": owners,
        })

    by = ("host", "shard")
    both = streams.groupBy(*by).cogroup(several.groupBy(*by))
    return both.applyInArrow(run, "host string, shard long, hash long, pages long, owner long")


def _judged(pages: DataFrame, repeated: DataFrame, width: int) -> DataFrame:
    """(page_id, url, text, n_boilerplate): what neither a label nor repetition removes from each page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(key, left, right):
        blocks, others, mains = (left.column(c).to_pylist() for c in ("blocks", "others", "main"))
        found = Streams([_stream(own) for own in blocks], width)
        covered = found.covered(right.column("hash").to_numpy())
        before = np.concatenate(([0], np.cumsum(covered)))
        at, texts, counts = 0, [], []
        for own, labels, main in zip(blocks, others, mains):
            kept, repeats = [], 0
            for text, other in zip(own, labels):
                size = text.count(" ") + 1
                repeats_here = 2 * (before[at + size] - before[at]) >= size
                repeats += int(repeats_here)
                if not other and not repeats_here:
                    kept.append(text)
                at += size
            texts.append("\n".join(kept) if main is None else main)
            counts.append(repeats)
        return pa.table([left.column("page_id"), left.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names)

    names = ["page_id", "url", "text", "n_boilerplate"]
    by = ("host", "shard", "part")
    made = pages.groupBy(*by).cogroup(repeated.groupBy(*by)).applyInArrow(run, f"page_id {kind}, url string, text string, n_boilerplate long")
    return made


def extract(pages: DataFrame, width: int = WIDTH, min_pages: int = MIN_PAGES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_boilerplate."""
    keys = stored(keyed(pages, width))
    context = pages.sparkSession.sparkContext
    judged = context.broadcast(bitmap(keys.select(F.explode("substrings").alias("hash")), _FILTER_BITS))
    sizes = keys.groupBy("host").agg(F.sum("n_tokens").alias("tokens"))
    shards = stored(sizes.select("host", (F.lit(1) + F.expr(f"tokens div {shard_tokens}")).alias("shards")))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(shards, "host").withColumn("shard", F.pmod("page_key", "shards")).drop("shards")

    keys = dealt(keys.drop("substrings"))
    # a page is listed once for all its copies; these are judged in several groups
    groups = keys.groupBy("host", "shard").agg(F.sum("n_tokens").alias("tokens"))
    groups = stored(groups.select("host", "shard", (F.lit(1) + F.expr(f"tokens div {2 * shard_tokens}")).alias("parts")))
    # a url that was read several times has several pages, maybe in several shards, which count as one
    distinct = keys.groupBy("host", "shard", "page_key").agg(F.min("url_key").alias("owner"))
    again = distinct.groupBy("host", "owner").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("host", "owner")
    several = distinct.join(again.hint("merge"), ["host", "owner"], "left_semi")
    listed = stored(_substrings(dealt(streamed(pages)), several, width, judged))
    often = listed.groupBy("host", "hash").agg((F.sum("pages") + F.count_distinct("owner")).alias("all"))
    often = often.where(F.col("all") >= min_pages).select("host", "hash").hint("merge")
    repeated = listed.where("owner IS NULL").join(often, ["host", "hash"], "left_semi").join(groups, ["host", "shard"])
    repeated = repeated.select("host", "shard", "hash", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    every = dealt(parsed(pages)).join(groups, ["host", "shard"])
    every = every.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts", "row", "page_key")
    removed = _judged(every, repeated, width)
    return removed.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_boilerplate")
