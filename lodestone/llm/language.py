"""Language identification with language-bitmask n-gram filters.

N-grams are runs of four UTF-8 bytes of the text (A-Z lower-cased; digits, punctuation and white space
become one separator). Training counts every n-gram by language over all training texts; an n-gram belongs
to each language in which its share is at least ``ratio`` of its largest share, if it stands there only once
too. A bit-sliced Bloom filter holds the memberships: a table of masks, one bit per language; an n-gram sets its languages' bits in
HASHES slots, and the AND of those slots returns all languages containing it at once. A text's popcount per
language, corrected for the filter's false positives (bit density ** HASHES), decides.

The filter is sized from the counted memberships: the least power of two of slots, at least SLOTS, at which
the bit density of the language with most n-grams is expected to stay within DENSITY (false positives within
DENSITY ** HASHES = 0.8 %). Its broadcast grows with the distinct n-grams of that language, about 14 to 27
slots each, 8 bytes a slot for each 64 languages. There are less than 2**32 distinct n-grams of four bytes.

* Null texts and texts without a letter (Unicode categories L*) are ``und`` with score 0. A text that matches nothing gets the most
  frequent language with its share as the score; without training rows it is ``und``.
* Rows with a null id are held out; repeated rows count as often as they stand; ties go to the more frequent
  language, then the smaller name. Very long texts are read in overlapping stretches of PIECE bytes. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, scratch, stage
from .quality import learnable
from .textnum import PIECE, U, flat, mix, pieces, small

SLOTS, HASHES, GRAM, DENSITY = 1 << 18, 3, 4, 0.2
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _lut() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[:0x80] = 0x20
    lut[0x61:0x7B] = np.arange(0x61, 0x7B)
    lut[0x41:0x5B] = np.arange(0x61, 0x7B)
    return lut


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, document) of each position; n-grams stay inside documents and hold no two separators."""
    b = _lut()[data]
    if len(b) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    m = len(b) - GRAM + 1
    g = np.zeros(m, np.uint32)
    gap = np.zeros(m, np.uint8)
    for k in range(GRAM):
        part = b[k : k + m]
        g |= part.astype(np.uint32) << np.uint32(8 * k)
        gap += part == 0x20
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = (gap < 2) & (doc[:m] == doc[GRAM - 1 :])
    return g[keep], doc[:m][keep]


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or any(map(str.isalpha, raw.decode("utf-8", "replace")))


def stretches(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(first document, last, start, end, offsets from start): groups of documents of about 2 * PIECE bytes; a longer
    document stands alone, in stretches that overlap so that each n-gram lies whole in one of them."""
    for i, j in pieces(offsets, 2 * PIECE):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * PIECE + GRAM:
            yield i, j, lo, hi, offsets[i : j + 1] - lo
        else:
            for at in range(lo, hi - GRAM + 1, PIECE):
                end = min(hi, at + PIECE + GRAM - 1)
                yield i, j, at, end, np.array([0, end - at])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    rows = 0

    def merged(parts):
        g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, at = np.unique(g, return_inverse=True)
        return u, np.bincount(at, n).astype(np.int64)

    def out():
        for lang, parts in held.items():
            u, n = merged(parts)
            yield pa.record_batch({"lang": pa.array([lang] * len(u), pa.string()), "gram": pa.array(u.astype(np.int64)), "n": pa.array(n)})

    for batch in small(batches, "_t"):
        data, off = flat(batch.column("_t"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j, lo, hi, part in stretches(off):
            g, doc = grams(data[lo:hi], part)
            named = langs[i:j]
            for lang in set(named):
                u, n = np.unique(g[(named == lang)[doc]], return_counts=True)
                held.setdefault(lang, []).append((u, n))
                rows += len(u)
        if rows > 3_000_000:
            held = {k: [merged(v)] for k, v in held.items()}
            rows = sum(len(v[0][0]) for v in held.values())
            if rows > 1_500_000:
                yield from out()
                held, rows = {}, 0
    yield from out()


class Filter:
    """The bit-sliced Bloom filter: ``masks`` is (words of 64 languages, slots)."""

    def __init__(self, langs: list[str], shares: list[float], masks: np.ndarray):
        self.langs, self.shares, self.masks = langs, shares, masks
        bits = np.array([((masks[k // 64] >> U(k % 64)) & U(1)).mean() for k in range(len(langs))])
        self.false = np.minimum(bits**HASHES, 0.999)

    def counts(self, g: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Hits by (document, language), in the last column all n-grams."""
        at = slots(g, self.masks.shape[1])
        out = np.zeros((n_docs, len(self.langs) + 1))
        for w in range(len(self.masks)):
            got = self.masks[w][at[0]]
            for row in at[1:]:
                got &= self.masks[w][row]
            for k in range(w * 64, min(len(self.langs), w * 64 + 64)):
                out[:, k] = np.bincount(doc, ((got >> U(k % 64)) & U(1)).astype(float), n_docs)
        out[:, -1] = np.bincount(doc, minlength=n_docs)
        return out

    def corrected(self, counts: np.ndarray) -> np.ndarray:
        return np.maximum(0, (counts[:, :-1] - counts[:, -1:] * self.false) / (1 - self.false))


def slots(g: np.ndarray, size: int = SLOTS) -> list[np.ndarray]:
    return [(mix(g.astype(U) + U((k + 1) << 40)) & U(size - 1)).astype(np.int64) for k in range(HASHES)]


def size_for(n: int) -> int:
    """Slots, a power of two, that keep the bit density of ``n`` n-grams within DENSITY."""
    size = SLOTS
    while 1 - math.exp(-HASHES * n / size) > DENSITY:
        size *= 2
    return size


def _slot_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("gram").to_numpy()
            for at in slots(g, size):
                yield pa.record_batch({"slot": pa.array(at), "word": batch.column("word"), "mask": batch.column("mask")})

    return run


def learn(train: DataFrame, ratio: float = 0.25) -> Filter | None:
    """``train``: (text, lang), lang not null. All texts count in full."""
    with scratch():
        return _learn(train, ratio)


def _learn(train: DataFrame, ratio: float) -> Filter | None:
    source = train.select("lang", F.coalesce("text", F.lit("")).cast("binary").alias("_t"))
    counts = stage(in_arrow(source, _count, "lang string, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "lang-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").cast("double").alias("total")).orderBy(F.desc("total"), "lang").collect()  # one row per language
    if not totals:
        return None
    langs = [r.lang for r in totals]
    every = sum(r.total for r in totals)
    number = F.create_map(*[x for k, r in enumerate(totals) for x in (F.lit(r.lang), F.struct(F.lit(k).alias("k"), F.lit(r.total).alias("total")))])
    share = counts.withColumn("l", number[F.col("lang")]).select("gram", F.col("l.k").alias("k"), (F.col("n") / F.col("l.total")).alias("p"))
    most = share.groupBy("gram").agg(F.max("p").alias("top"))
    member = share.join(most, "gram").where(F.col("p") >= ratio * F.col("top"))
    member = stage(member.select("gram", "k"), "lang-members")
    size = size_for(max(r["count"] for r in member.groupBy("k").count().collect()))
    member = member.groupBy("gram", F.floor(F.col("k") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("mask"))
    rows = in_arrow(member, _slot_rows(size), "slot bigint, word int, mask bigint").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(((len(langs) + 63) // 64, size), U)
    masks[rows.column("word").to_numpy(), rows.column("slot").to_numpy()] = rows.column("mask").to_numpy().astype(U)
    return Filter(langs, [r.total / every for r in totals], masks)


def identify(docs: DataFrame, model: Filter | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` with lang_pred and score."""
    source = docs.select(*keep, F.col(text_col).cast("binary").alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches, "_t"):
            col = batch.column("_t")
            data, off = flat(col)
            n = len(off) - 1
            if model is None:
                pred, score = ["und"] * n, [0.0] * n
            else:
                found = np.zeros((n, len(model.langs) + 1))
                for i, j, lo, hi, part in stretches(off):
                    found[i:j] += model.counts(*grams(data[lo:hi], part), j - i)
                hits = model.corrected(found)
                total, best = hits.sum(axis=1), hits.argmax(axis=1)  # languages stand by frequency, then name
                pred, score = [], []
                for d in range(n):
                    if not has_letter(data[off[d] : off[d + 1]].tobytes()):
                        pred.append("und")
                        score.append(0.0)
                    elif total[d] > 0:
                        pred.append(model.langs[best[d]])
                        score.append(float(hits[d, best[d]] / total[d]))
                    else:
                        pred.append(model.langs[0])
                        score.append(float(model.shares[0]))
            yield pa.record_batch({c: batch.column(c) for c in names} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    head = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "_t")
    return in_arrow(source, run, f"{head}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Contract rows (doc_id, held_out, lang_pred, score)."""
    model = learn(docs.where(learnable(F.col("doc_id"), 5, 0) & F.col("lang").isNotNull()).select("text", "lang"))
    out = identify(docs, model)
    return out.select("doc_id", (~learnable(F.col("doc_id"), 5, 0)).alias("held_out"), "lang_pred", "score")
