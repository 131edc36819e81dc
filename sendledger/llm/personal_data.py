r"""Personal data: labellers vote on candidate spans, and a classifier trained on the votes decides.

Base spans (email, ip, card, phone) always stay. Further candidates (national ids,
names after a title, handles, spelled-out addresses) are added where the final classifier takes
them for personal data. Four labellers vote on every candidate: its form, gazetteers,
the words before it, and the variety of its characters. Expectation-maximisation over the
counted vote patterns of the whole corpus gives their reliabilities; the posteriors of a bounded
sample of candidates (``max_training`` of them, by hash) train a linear scorer over
hashed form and context features, which then scores every candidate.

Defined results: a null or empty text has no spans. Repeated rows are judged alike.
Without candidates nothing is trained. An empty table gives an empty result; other
columns are ignored. Spans are in code points, the end exclusive. All scans run in time
linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sendledger.llm.common import pieces, stored
from sendledger.llm.weak import ABSTAIN, Linear, Reliabilities, choose, feature_sums, flat, sigmoid

KINDS = ("email", "ip", "card", "phone", "id", "name", "handle", "spelled")
BASE = 4
_FEATURES = 2**14

# The patterns of the base spans.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# The further candidates.
_ID = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![0-9A-Za-z-])")
_NAME = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?")
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+@-])@[A-Za-z0-9_]{3,30}(?![A-Za-z0-9_.])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z]{2,10}")

# Gazetteers.
_ENDINGS = frozenset("com org net edu gov info biz io de fr es it uk us eu ch at nl be ca au jp in br mx".split())
_DIAL = ("1", "7", "20", "27", "3", "4", "5", "6", "8", "90", "91", "92", "98")
_NAMES = frozenset(
    "james john robert michael william david mary patricia jennifer linda anna maria jose juan carlos luis pierre jean "
    "marie claire hans peter klaus ursula sofia laura paul thomas daniel sarah emma julia martin".split()
)
_BEFORE_YES = re.compile(
    r"mail|contact|write|call|phone|tel|mobil|fax|card|visa|account|konto|address|adresse|host|server|login|user|name|ssn|from|correo|kontakt",
    re.I,
)
_BEFORE_NO = re.compile(r"version|build|release|chapter|section|isbn|figure|table|example|sample|noreply", re.I)


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[0::2]) + sum(d * 2 - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of all base spans, by start, then kind."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                parts = [p.lstrip("0") for p in m.group().split(".")]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m.group()) if m.end() - m.start() <= 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def further_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates beyond the base spans."""
    spans = []
    if _DIGIT.search(text):
        spans += [(m.start(), 4, m.end()) for m in _ID.finditer(text)]
    spans += [(m.start(), 5, m.end()) for m in _NAME.finditer(text)]
    if "@" in text:
        spans += [(m.start(), 6, m.end()) for m in _HANDLE.finditer(text)]
    if "at" in text or "AT" in text:
        spans += [(m.start(), 7, m.end()) for m in _SPELLED.finditer(text)] if "[" in text or "(" in text else []
    return spans


def votes(text: str, start: int, kind: int, stop: int) -> list[int]:
    """Form, gazetteer, context and variety: 1 personal, 0 not, 2 no opinion."""
    value, before = text[start:stop], text[max(0, start - 40) : start]
    digits = "".join(_DIGIT.findall(value))
    form = gazetteer = ABSTAIN
    if kind in (0, 7):
        form = int(value[-2:].isalpha())
        gazetteer = int(re.split(r"[^A-Za-z]", value)[-1].lower() in _ENDINGS)
    elif kind == 1:
        parts = value.split(".")
        form = int(all(p == "0" or p[0] != "0" for p in parts))
        gazetteer = int(parts[0] not in ("0", "10", "127", "255") and parts[:2] != ["192", "168"])
    elif kind == 2:
        form = int(digits[0] in "3456")
        gazetteer = 0 if digits.startswith(("411111111111", "424242424242")) else ABSTAIN
    elif kind == 3:
        form = int(10 <= len(digits) <= 13)
        gazetteer = int(digits.startswith(_DIAL))
    elif kind == 4:
        form = int(len(value) == 11 or len(value) >= 15)
    elif kind == 5:
        form = int(value.count(" ") == 2) or ABSTAIN
        gazetteer = int(bool(_NAMES & {w.lower() for w in value.split()})) or ABSTAIN
    context = 1 if _BEFORE_YES.search(before) else 0 if _BEFORE_NO.search(before) else ABSTAIN
    varied = int(len(set(digits or value)) >= min(4, len(digits or value)))
    return [form, gazetteer, context, varied]


def _features(text: str, start: int, kind: int, stop: int, cast: list[int]) -> list[int]:
    import xxhash

    value = text[start:stop]
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "0", value[:60])))
    names = [f"kind {kind}", f"shape {kind} {shape}", f"length {kind} {(stop - start).bit_length()}"]
    names += [f"vote {k} {v}" for k, v in enumerate(cast)]
    names += [f"before {w}" for w in text[max(0, start - 40) : start].lower().split()[-2:]]
    return sorted({xxhash.xxh64_intdigest(n) % _FEATURES for n in names})


_SPAN = pa.struct([
    ("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("votes", pa.list_(pa.int32())),
    ("features", pa.list_(pa.int32())),
])
_SPANS = "array<struct<start:int,kind:int,stop:int,votes:array<int>,features:array<int>>>"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every candidate of a row with its votes and features."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                found = []
                for start, what, stop in sorted(base_spans(text) + further_spans(text)) if text else ():
                    cast = votes(text, start, what, stop)
                    found.append({"start": start, "kind": what, "stop": stop, "votes": cast,
                                  "features": _features(text, start, what, stop, cast)})
                rows.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {_SPANS}")


def fit(found: DataFrame, max_training: int = 20_000) -> tuple[Reliabilities, np.ndarray, float]:
    """Reliabilities over all candidates; weights and bias of the classifier trained on ``max_training`` of them."""
    each = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    counted = each.groupBy("kind", "votes").count().collect()  # at most kinds * 3^4 rows
    labellers = Reliabilities(4, len(KINDS))
    if not counted:
        return labellers, np.zeros(_FEATURES, np.float32), 0.0
    labellers.fit(
        np.array([r.votes for r in counted]), np.array([r.kind for r in counted]), np.array([float(r["count"]) for r in counted])
    )
    chosen = each.orderBy(F.xxhash64("doc_id", "start", "kind"), "doc_id", "start", "kind").limit(max_training)
    rows = chosen.select("kind", "votes", "features").collect()
    wanted = labellers.posterior(np.array([r.votes for r in rows]), np.array([r.kind for r in rows]))[None, :]
    features, row = flat(r.features for r in rows)
    used, own = choose(feature_sums(features, row, wanted, _FEATURES), least=2.0, effect=0.0)
    number = np.full(_FEATURES, -1)
    number[used] = np.arange(len(used))
    inside = number[features] >= 0
    model = Linear(own, wanted.mean(axis=1))
    for _ in range(60):
        model.move(model.gradient(number[features[inside]], row[inside], wanted))
    return labellers, model.spread(used, _FEATURES)[0], float(model.bias[0])


def personal_data(docs: DataFrame, max_training: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (start, kind, stop)."""
    found = stored(candidates(docs))
    _, *fitted = fit(found, max_training)
    weights = docs.sparkSession.sparkContext.broadcast(fitted)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = weights.value
        for batch in pieces(batches):
            rows = []
            for spans in batch.column("spans").to_pylist():
                rows.append([
                    {"start": s["start"], "kind": s["kind"], "stop": s["stop"],
                     "score": float(sigmoid(np.array(weight[s["features"]].sum() + bias)))}
                    for s in spans
                ])
            kinds = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kinds))], ["doc_id", "scored"])

    scored = found.mapInArrow(run, f"doc_id {kind}, scored array<struct<start:int,kind:int,stop:int,score:double>>")

    def base(s):
        return s["kind"] < BASE

    return scored.select(
        "doc_id",
        F.filter("scored", base).alias("base"),
        F.filter("scored", lambda s: base(s) | (s["score"] >= 0.5)).alias("spans"),
    )


def joined(spans):
    """``kind:start:stop`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    )
    return F.array_join(each, ",")
