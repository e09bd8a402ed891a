"""Personal data: base detectors plus bootstrapped contextual extraction.

Base detectors find seeds: e-mail and IP addresses, payment cards (Luhn) and phone numbers. Each seed and
each further identifier-like string (a number run, a token with an at sign, a run of hexadecimal groups)
is an instance with lexical patterns: the one and the two words that stand whole within the CONTEXT characters
before it, a ``key=`` before it included.
Spark scores the pattern-instance graph: a pattern's confidence in a kind is the mean score of its
distinct instances (smoothed), an instance's score the noisy-or over its patterns, seeds stay at 1; a few
rounds settle it. Patterns need ``min_seeds`` distinct seeds to enter the graph at all. Unseen identifiers
of a fitting shape next to patterns of at least ``confidence`` become additional spans.

The text is read once; the graph is aggregated by (pattern, instance) before it is shuffled, and the rows
that gained spans meet the documents again by key.

* Null texts count as empty and have no spans. Repeated rows get the same spans. Offsets are code points.
* Very long texts: every detector is linear in the text, and so is the sweep that keeps candidates off base spans. Ties in confidence go to the kind listed first.
* Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import cut, in_arrow, row_key, scratch, small_side, stage
from .textnum import small

CONTEXT = 120
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ from each at sign: the local part is the run before it."""
    last, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            yield s, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if len(m[0]) >= 14 and 14 <= len(d := "".join(_DIGITS.findall(m[0]))) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_NUMBER = re.compile(r"\(?[0-9](?:[0-9().\x20-]*[0-9])?")
_AT = re.compile(r"[^\s<>\"',;()\[\]]+")
_GROUPS = re.compile(r"[0-9A-Fa-f]++(?:[.:]{1,2}[0-9A-Fa-f]++){3,}")


def shapes(value: str) -> list[int]:
    """Kinds whose shape a value fits."""
    digits = len(_DIGITS.findall(value))
    plain = re.fullmatch(r"[0-9().\x20+-]+", value) is not None
    return (
        [0] * (0 < value.find("@") < len(value) - 1 and value.count("@") == 1)
        + [1] * bool(_GROUPS.fullmatch(value) and digits)
        + [2] * (plain and 12 <= digits <= 19)
        + [3] * (plain and 7 <= digits <= 15)
    )


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings outside base spans."""
    found: set[tuple[int, int]] = set()
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 7 and len(_DIGITS.findall(m[0])) >= 7:
            found.add(m.span())
    for m in _GROUPS.finditer(text):
        found.add(m.span())
    if "@" in text:
        found.update(m.span() for m in _AT.finditer(text) if "@" in m[0])
    out, starts, reaches, reach = [], [x for x, _, _ in base], [], 0
    for _, _, y in base:  # base is sorted by start
        reach = max(reach, y)
        reaches.append(reach)
    for s, e in sorted(found):
        while e > s and text[e - 1] in ".:-":
            e -= 1
        before = bisect_left(starts, e)  # base spans that start before e; one of them ends behind s, or none overlaps
        if not (before and reaches[before - 1] > s) and shapes(text[s:e]):
            out.append((s, e))
    return out


def contexts(text: str, start: int) -> list[str]:
    """Lexical patterns left of an instance: its last word, and its last two."""
    window = text[max(0, start - CONTEXT) : start]
    left = window.lower().split()
    if start > CONTEXT and not window[0].isspace():  # the first one may be the end of a word
        left = left[1:]
    left = left[-2:]
    left = ["".join(c if not c.isdigit() else "0" for c in w).strip("\"'()[]<>") for w in left]
    left = [w for w in left if w]
    return ([left[-1]] if left else []) + ([" ".join(left)] if len(left) == 2 else [])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("fits", pa.list_(pa.int32())), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in small(batches, "_t"):
        bases, instances = [], []
        for t in batch.column("_t"):
            text = t.as_py()
            if not _ANY.search(text):
                bases.append([])
                instances.append([])
                continue
            base = base_spans(text)
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            near = [{"start": s, "end": e, "kind": k, "fits": [k], "value": text[s:e].lower(), "patterns": contexts(text, s)} for s, k, e in base]
            near += [{"start": s, "end": e, "kind": -1, "fits": shapes(text[s:e]), "value": text[s:e].lower(), "patterns": contexts(text, s)} for s, e in candidates(text, base)]
            instances.append(near)
        yield pa.record_batch({c: batch.column(c) for c in ("doc_id", "_k")} | {"base": pa.array(bases, pa.list_(span)), "seen": pa.array(instances, pa.list_(seen))})


def _scanned(docs: DataFrame) -> DataFrame:
    source = docs.select("doc_id", row_key("doc_id", "text").alias("_k"), F.coalesce("text", F.lit("")).alias("_t"))
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, _k binary, base array<struct<start: int, kind: int, end: int>>, seen array<struct<start: int, end: int, kind: int, fits: array<int>, value: string, patterns: array<string>>>"
    return stage(in_arrow(source, _scan, schema), "pii-scan")


def discover(scan: DataFrame, min_seeds: int = 3, rounds: int = 3, confidence: float = 0.5) -> DataFrame:
    """(_k, extra): additional spans of the rows that have any."""
    instance = scan.where(F.size("seen") > 0).select("_k", F.explode("seen").alias("i"))
    edges = instance.select(F.explode("i.patterns").alias("p"), F.col("i.value").alias("x"), F.col("i.kind").alias("seed")).distinct()
    edges = stage(edges, "pii-edges")
    induced = edges.where("seed >= 0").groupBy("p", "seed").agg(F.countDistinct("x").alias("n")).where(F.col("n") >= min_seeds)
    induced = stage(induced.select("p", F.col("seed").alias("kind")), "pii-induced")
    graph = stage(edges.join(induced, "p").select("p", "kind", "x", (F.col("seed") == F.col("kind")).alias("is_seed")).groupBy("p", "kind", "x").agg(F.max("is_seed").alias("is_seed")), "pii-graph")
    score = graph.groupBy("x", "kind").agg(F.max("is_seed").cast("double").alias("s"))
    pattern = None
    for _ in range(rounds):
        pattern = graph.join(score, ["x", "kind"]).groupBy("p", "kind").agg((F.sum("s") / (F.count("*") + 1)).alias("c"))
        rest = graph.join(pattern, ["p", "kind"]).groupBy("x", "kind").agg(F.max("is_seed").alias("seed"), F.sum(F.log1p(-F.least("c", F.lit(0.999)))).alias("miss"))
        score = cut(rest.select("x", "kind", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("miss")).alias("s")))
    good = stage(pattern.where(F.col("c") >= confidence), "pii-patterns")
    new = instance.where("i.kind < 0").select("_k", "i.start", "i.end", "i.fits", F.explode("i.patterns").alias("p"))
    hit = new.join(small_side(good), "p").where("array_contains(fits, kind)")
    best = hit.groupBy("_k", "start", "end").agg(F.max_by("kind", F.struct("c", -F.col("kind"))).alias("kind"))
    return best.groupBy("_k").agg(F.collect_set(F.struct("start", "kind", "end")).alias("extra"))


def find_pii(docs: DataFrame) -> DataFrame:
    """Contract rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    with scratch():
        scan = _scanned(docs)
        extra = stage(discover(scan), "pii-extra", keep=True)
        base = stage(scan.select("doc_id", "_k", "base"), "pii-base", keep=True)
    both = base.join(small_side(extra), "_k", "left")
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    extra_spans = F.coalesce("extra", F.array().cast("array<struct<start: int, kind: int, end: int>>"))
    return both.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.concat("base", extra_spans)).alias("spans"), F.size(extra_spans).cast("bigint").alias("n_added"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every found span replaced by its kind in brackets; n_chars, if there, follows.
    Null and empty texts stay as they are, and so do all other columns; repeated rows are masked alike; of spans
    that overlap the first is replaced, up to where the last ends. Very long texts: as above."""
    with scratch():
        extra = stage(discover(_scanned(docs)), "pii-extra", keep=True)
    plain = [f"c{k}" for k in range(len(docs.columns))]
    text, chars = (docs.columns.index(c) if c in docs.columns else -1 for c in ("text", "n_chars"))
    keyed = docs.select("*", row_key("doc_id", "text").alias("_k")).toDF(*plain, "_k")
    joined = keyed.join(small_side(extra), "_k", "left").select(*plain, "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text):
            texts = []
            for t, more in zip(batch.column(text).to_pylist(), batch.column("extra").to_pylist()):
                if t is not None and _ANY.search(t):
                    spans = sorted(base_spans(t) + [(m["start"], m["kind"], m["end"]) for m in more or ()])
                    parts, last = [], 0
                    for s, k, e in spans:
                        if s >= last:
                            parts += [t[last:s], f"[{KINDS[k].upper()}]"]
                        last = max(last, e)
                    t = "".join(parts) + t[last:] if spans else t
                texts.append(t)
            out = [batch.column(k) for k in range(len(plain))]
            out[text] = pa.array(texts, out[text].type)
            if chars >= 0:
                out[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(out[chars].type)
            yield pa.record_batch(out, names=plain)

    masked_rows = in_arrow(joined, run, StructType([StructField(p, f.dataType, f.nullable) for p, f in zip(plain, docs.schema)]))
    return masked_rows.select(*[F.col(p).alias(f.name, metadata=f.metadata) for p, f in zip(plain, docs.schema)])
