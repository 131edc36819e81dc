"""Secrets in text, and whose they are.

Patterns give base spans (assignments, access keys, long hex strings). The values are
hashed, and the hashes counted over the whole corpus by distinct owners, repositories and texts:
a value that several owners or repositories hold, or more than ``max_texts`` different texts of one repository, is a
copied example; one of a single owner and repository in few texts that looks random is live-looking, and
its places are added as ``live`` spans. Counts are combined per (value, owner, repository, text) before they meet, each
distinct text's spans are joined once, and a text that many rows hold is met in several tasks.
Built-in functions only.

Parameter: ``max_texts`` (5).

Defined results: a null text is empty. A row without owner or repository counts under an
empty name. Repeated rows count once per owner and repository and are reported
each. An empty table gives an empty result; other columns are ignored. Long texts are read whole; the places of
a text's matches are sums over blocks of 64 and of 4096 lengths, so the time grows with their number. Spans are
``kind:start:end`` in code points, the end exclusive, by start, then assign, access,
hex, live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sendledger.llm.common import stored, text_key

KINDS = ("assign", "access", "hex", "live")
# The patterns of the base spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MAX_TEXTS = 5
_SALTS = 16
_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


_BLOCK = 64  # lengths summed at once, and sums summed at once


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _block_sums(numbers: Column) -> Column:
    """The sums of each ``_BLOCK`` numbers in turn."""
    last = F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: _sum(F.slice(numbers, k * _BLOCK + 1, F.lit(_BLOCK))))
    return F.when(F.size(numbers) > 0, blocks).otherwise(F.array().cast("array<int>"))


def _first(numbers: Column, n: Column) -> Column:
    return F.when(n > 0, _sum(F.slice(numbers, F.lit(1), F.greatest(n, F.lit(1))))).otherwise(0)


def _up_to(kind: int, i: Column) -> Column:
    """The sum of the first ``i`` lengths: whole blocks of blocks, then whole blocks, then single lengths."""
    lengths, blocks, large = (F.col(f"{name}_{kind}") for name in ("steps", "blocks", "large"))

    def rest(numbers: Column, first: Column, n: Column) -> Column:
        return F.when(n > 0, _sum(F.slice(numbers, first + 1, F.greatest(n, F.lit(1))))).otherwise(0)

    whole, single = F.floor(i / _BLOCK).cast("int"), F.pmod(i, F.lit(_BLOCK))
    larger = F.floor(whole / _BLOCK).cast("int")
    return (
        _first(large, larger)
        + rest(blocks, larger * _BLOCK, F.pmod(whole, F.lit(_BLOCK)))
        + rest(lengths, whole * _BLOCK, single)
    )


# Of each kind: its pattern, the group that holds the value, and the fewest characters of a value.
_PATTERNS = ((ASSIGN, 2, 6), (ACCESS, 0, 1), (HEX, 0, 1))


def with_base_spans(rows: DataFrame, text: Column) -> DataFrame:
    """Adds ``spans``, all base spans of a text by start, then kind.

    The pieces between the matches and the matches themselves give each place. One projection makes the lengths,
    the next ones their sums, so that nothing is worked out anew for every match.
    """
    none = F.array().cast("array<string>")
    kept = rows.columns
    made = rows.select(*kept, *[
        F.when(F.rlike(text, F.lit(p)), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"found_{k}")
        for k, (p, *_) in enumerate(_PATTERNS)
    ], *[
        F.when(F.rlike(text, F.lit(p)), F.transform(F.split(text, p, -1), F.length)).otherwise(F.array().cast("array<int>")).alias(f"gaps_{k}")
        for k, (p, *_) in enumerate(_PATTERNS)
    ])
    kinds = range(len(_PATTERNS))

    def step(k: int) -> Column:  # a gap and the match behind it
        both = F.zip_with(f"gaps_{k}", f"found_{k}", lambda gap, found: gap + F.length(found))
        return F.filter(both, lambda n: n.isNotNull()).alias(f"steps_{k}")  # the last gap has no match

    made = made.select(*kept, *[f"found_{k}" for k in kinds], *[step(k) for k in kinds])
    made = made.select("*", *[_block_sums(F.col(f"steps_{k}")).alias(f"blocks_{k}") for k in kinds])
    made = made.select("*", *[_block_sums(F.col(f"blocks_{k}")).alias(f"large_{k}") for k in kinds])

    def spans(k: int) -> Column:
        pattern, group, least = _PATTERNS[k]

        def span(found: Column, i: Column) -> Column:
            stop = _up_to(k, i + 1)
            value = F.regexp_extract(found, pattern, group) if group else found
            return F.struct((stop - F.length(found)).alias("start"), F.lit(k).alias("kind"), stop.alias("stop"), value.alias("value"))

        return F.filter(F.transform(f"found_{k}", span), lambda s: F.length(s["value"]) >= least)

    return made.select(*kept, F.array_sort(F.concat(*[spans(k) for k in kinds])).cast(_SPAN).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    )
    return F.array_join(each, ",")


def looks_random(value: Column) -> Column:
    """Long and varied: 12 characters or more, 8 different ones, a digit and a letter among them."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return (F.length(value) >= 12) & varied & F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))


def found_secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(doc_id, text_key, owner, repository, spans): the base spans of each row, written once."""
    empty = F.lit("")
    rows = docs.select(
        "doc_id",
        F.coalesce(owner.cast("string"), empty).alias("owner"),
        F.coalesce(repository.cast("string"), empty).alias("repository"),
        F.coalesce(F.col("text"), empty).alias("text"),
    )
    made = with_base_spans(rows, F.col("text"))
    return stored(made.select("doc_id", text_key(F.col("text")).alias("text_key"), "owner", "repository", "spans"))


def ownership(found: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """One row per secret value: its hash, places, texts, repositories, owners and whether it is live-looking.

    ``texts`` are counted inside each repository and added up.
    """
    names = ["secret", "random", "owner", "repository"]
    each = found.where(F.size("spans") > 0).select("owner", "repository", "text_key", F.explode("spans").alias("s"))
    each = each.select("owner", "repository", "text_key", F.unhex(F.sha2("s.value", 256)).alias("secret"),
                       looks_random(F.col("s.value")).alias("random"))
    by_text = each.groupBy(*names, "text_key").agg(F.count("*").alias("places"))
    by_place = by_text.groupBy(*names).agg(F.sum("places").alias("places"), F.count("*").alias("texts"))
    by_owner = by_place.groupBy(*names[:3]).agg(
        F.sum("places").alias("places"), F.sum("texts").alias("texts"), F.count("*").alias("repositories")
    )
    totals = by_owner.groupBy(*names[:2]).agg(
        *[F.sum(n).alias(n) for n in ("places", "texts", "repositories")], F.count("*").alias("owners")
    )
    own = (F.col("owners") == 1) & (F.col("repositories") == 1) & (F.col("texts") <= max_texts)
    return totals.withColumn("live", F.col("random") & own)


def scan_secrets(
    docs: DataFrame, owner: Column | None = None, repository: Column | None = None, max_texts: int = MAX_TEXTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, base (spans), spans (with the live ones)."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    found = found_secrets(docs, owner, repository)
    live = ownership(found, max_texts).where("live").select("secret")
    each = found.where(F.size("spans") > 0).select("text_key", F.explode("spans").alias("s")).distinct()
    each = each.withColumn("secret", F.unhex(F.sha2("s.value", 256))).join(live, "secret", "left_semi")
    added = each.groupBy("text_key").agg(
        F.collect_set(
            F.struct((F.col("s.stop") - F.length("s.value")).alias("start"), F.lit(3).alias("kind"),
                     F.col("s.stop").alias("stop"), F.col("s.value").alias("value"))
        ).alias("added")
    )
    # a text with a live value stands in few repositories, but one of them may hold many copies of it
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    rows = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int"))
    rows = rows.join(added.select("*", salts), ["text_key", "salt"], "left")
    every = F.array_sort(F.concat("spans", F.coalesce("added", F.array().cast(_SPAN))))
    return rows.select("doc_id", F.col("spans").alias("base"), every.alias("spans"))
