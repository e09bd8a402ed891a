"""Exact substring deduplication by bucket refinement, with content hashes in place of bucket pointers.

A byte goes if it lies in a string of ``size`` bytes (a window) that also starts elsewhere, in the same
document or another. Suffixes start in buckets of their first GRAM bytes and the buckets are refined by hashes
of the bytes at later offsets, until a bucket holds equal windows only or one window alone. Bucket-pointer
refinement would read the identifiers of the buckets that later offsets fall into; no such identifier is read
here, as it takes a bucket row for every suffix, and only anchors have one.

Only anchored suffixes get buckets: the anchor of a window is the position, inside it, of its least GRAM-byte
hash, so equal windows have equal anchors at equal offsets, and about one position in 69 is an anchor. Each
anchor stands for a run of consecutive windows. Per round,

* a bucket of one suffix has no repeated window and ends;
* suffixes that agree on the whole stretch of their runs repeat as a whole: their windows are marked, and one
  of them alone goes on to be compared with the rest of the bucket;
* the others go on: their runs are cut into aligned pieces of 32, 8, 2 and 1 offsets, whose buckets are
  formed again from a hash of the bytes that all windows of the piece share (the core).

A round moves only suffixes whose bucket is still mixed, those near the ends of repeated passages. All
grouping is by content hash, so hot passages combine map-side and otherwise spread by their contexts; rows meet
hot buckets by broadcast, where they are.
Hashes have 64 bits on top of the bucket's own 64.

* Null texts count as empty; texts shorter than ``size`` lose nothing. Rows that repeat repeat each other.
* Very long texts are processed in overlapping stretches of PIECE bytes. Empty tables give empty results.
* Extra columns are ignored. Ties between equal hashes in a window go to the leftmost position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_ROWS, in_arrow, scratch, small_side, spread_join, stage, unstage
from .textnum import PIECE, U, flat, mix, pieces, powers

SIZE, GRAM, PIECES = 200, 64, (32, 8, 2, 1)
_INVERSE = pow(int(powers(2)[1]), -1, 1 << 64)
_LOW = U((1 << 24) - 1)


class _Hasher:
    """Polynomial hashes of any substring of a buffer of up to PIECE + 2 * size bytes."""

    def __init__(self, length: int):
        self.p = powers(length + 1)
        self.inv = np.full(length + 1, U(_INVERSE))
        self.inv[0] = 1
        np.multiply.accumulate(self.inv, out=self.inv)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        s = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * self.p[: len(data)], out=s[1:])
        return s


def _anchors(data: np.ndarray, offsets: np.ndarray, hasher: _Hasher, size: int, gram: int):
    """For windows inside documents: (doc, first window, further windows, anchor - first, gram hash, stretch hash)."""
    n = len(data)
    if n < size:
        return None
    s = hasher.prefix(data)
    m = n - gram + 1
    g = mix((s[gram:] - s[:m]) * hasher.inv[:m])
    low = (g & ~_LOW) | np.arange(m, dtype=U)
    width, span = size - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (low & _LOW).astype(np.int64)  # anchor of window p, for p = 0 .. n - size
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    p = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
    if not len(p):
        return None
    a, d = at[p], doc[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    p1, p2, x = p[first], p[last], a[first]
    u = mix((s[p2 + size] - s[p1]) * hasher.inv[p1] + (p2 - p1).astype(U) + ((x - p1).astype(U) << U(32)))
    return d[first], p1, p2 - p1, x - p1, g[x], u


def _anchor_rows(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(PIECE + 2 * size)
        for batch in batches:
            data, off = flat(batch.column("_t"))
            keys = batch.column("_k").to_numpy(zero_copy_only=False)
            length = np.diff(off)
            for i, j in pieces(off):
                lo, hi = int(off[i]), int(off[j])
                for at in range(lo, max(hi - size + 1, lo + 1), PIECE):  # one stretch unless a long document
                    end = min(hi, at + PIECE + size - 1) if hi - lo > PIECE + size else hi
                    got = _anchors(data[at:end], off[i : j + 1] - off[i] if at == lo and end == hi else np.array([0, end - at]), hasher, size, gram)
                    if got is not None:
                        d, p1, more, x, g, u = got
                        yield pa.record_batch(
                            {
                                "gram": pa.array(g.astype(np.int64)), "u": pa.array(u.astype(np.int64)), "_k": pa.array(keys[i + d]), "n": pa.array(length[i + d]),
                                "p1": pa.array(p1 + at - off[i + d]), "more": pa.array(more.astype(np.int32)), "x": pa.array(x.astype(np.int32)),
                            }
                        )
                    if end == hi:
                        break

    return run


def _resolve(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """One refinement of buckets ``core`` by stretches ``u``: (repeated runs, rows that go on).

    ``rows``: core, u, multi and an owner (_k, n) with p1, more. A row that is ``multi`` stands for two or
    more equal ones, marked already.
    """
    weight = F.when(F.col("multi"), 2).otherwise(1)
    bucket = rows.groupBy("core").agg(F.sum(weight).alias("w"), F.min("u").alias("u0"), F.max("u").alias("u1")).where("w > 1")
    bucket = stage(bucket.select("core", "w", (F.col("u0") != F.col("u1")).alias("mixed")), f"{label}-buckets")
    met = stage(spread_join(rows, bucket, ["core"], "w").drop("w"), f"{label}-met")
    unstage(bucket)
    uniform = stage(met.where("not mixed and not multi").select("_k", "n", "p1", "more"), f"{label}-uniform")
    mixed = met.where("mixed")
    tag = F.xxhash64("_k", "n", "p1")
    same = stage(mixed.groupBy("core", "u").agg(F.sum(weight).alias("w"), F.min(tag).alias("tag")).where("w > 1"), f"{label}-same")
    seen = stage(spread_join(mixed, same, ["core", "u"], "w", "left").drop("core", "mixed"), f"{label}-mixed")
    unstage(met)
    unstage(same)
    runs = uniform.unionByName(seen.where("w > 1 and not multi").select("_k", "n", "p1", "more"))
    on = seen.where(F.col("w").isNull() | (tag == F.col("tag"))).withColumn("multi", F.col("w").isNotNull()).drop("w", "tag", "u")
    return runs, on


def _contexts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n, text, marks in zip(*(batch.column(c).to_pylist() for c in ("_k", "n", "_t", "marks"))):
                out = [(k, n, m["p1"], m["more"], m["x"], m["multi"], m["gram"], text[m["p1"] : m["p1"] + m["more"] + size]) for m in marks]
                cols = list(zip(*out))
                yield pa.record_batch(
                    {
                        "_k": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "p1": pa.array(cols[2], pa.int64()), "more": pa.array(cols[3], pa.int32()),
                        "x": pa.array(cols[4], pa.int32()), "multi": pa.array(cols[5], pa.bool_()), "gram": pa.array(cols[6], pa.int64()), "c": pa.array(cols[7], pa.binary()),
                    }
                )

    return run


def repeated_runs(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(_k, n, p1, more): windows p1 .. p1 + more of the document with key _k and n bytes repeat."""
    source = docs.select("_k", "n", "_t")
    anchors = stage(in_arrow(source.where(F.col("n") >= size).select("_k", "_t"), _anchor_rows(size, gram), "gram bigint, u bigint, _k bigint, n bigint, p1 bigint, more int, x int"), "sub-anchors")
    runs, on = _resolve(anchors.withColumnRenamed("gram", "core").withColumn("gram", F.col("core")).withColumn("multi", F.lit(False)), "sub0")
    unstage(anchors)
    found = [runs]
    marks = stage(on.groupBy("_k", "n").agg(F.collect_list(F.struct("p1", "more", "x", "multi", "gram")).alias("marks")), "sub-marks")
    marked = source.join(small_side(marks.select("_k", "n"), KEY_ROWS), ["_k", "n"], "left_semi")  # only their texts move
    held = in_arrow(marked.join(marks, ["_k", "n"]), _contexts(size), "_k bigint, n bigint, p1 bigint, more int, x int, multi boolean, gram bigint, c binary")
    held = stage(held, "sub-contexts")
    for step in PIECES:
        # offsets of a row's windows before the anchor: x - more .. x; piece b holds b * step .. b * step + step - 1
        cut = held.withColumn("b", F.explode(F.sequence(F.floor((F.col("x") - F.col("more")) / step), F.floor(F.col("x") / step))))
        high = F.least(F.col("x").cast("bigint"), F.col("b") * step + step - 1)
        lowest = F.greatest((F.col("x") - F.col("more")).cast("bigint"), F.col("b") * step)
        core = F.substring("c", (F.col("x") - F.col("b") * step + 1).cast("int"), F.lit(size - step + 1))
        cut = cut.select(
            "_k", "n", (F.col("p1") + F.col("x") - high).alias("p1"), (high - lowest).cast("int").alias("more"), high.cast("int").alias("x"), "multi", "gram",
            F.substring("c", (F.col("x") - high + 1).cast("int"), (high - lowest + size).cast("int")).alias("c"), F.xxhash64("gram", "b", core).alias("core"),
        )
        runs, held = _resolve(cut.withColumn("u", F.xxhash64("c", "x", F.lit(step))), f"sub{step}")
        found.append(runs)
        if step > 1 and held.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _kept(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digest = [], [], []
            for text, runs in zip(batch.column("_t"), batch.column("runs")):
                raw = text.as_buffer() if text.is_valid else b""
                cuts = covered(runs, size)
                h, last = hashlib.sha256(), 0
                view = memoryview(raw)
                for a, b in cuts:
                    h.update(view[last:a])
                    last = b
                h.update(view[last:])
                removed.append(sum(b - a for a, b in cuts))
                spans.append(len(cuts))
                digest.append(h.hexdigest())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return run


def covered(runs, size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the windows of ``runs``."""
    if not runs.is_valid or not len(runs.values):
        return []
    p, m = (runs.values.field(c).to_numpy().astype(np.int64) for c in ("p1", "more"))
    order = np.argsort(p, kind="stable")
    p, end = p[order], np.maximum.accumulate((p + m + size)[order])
    first = np.ones(len(p), bool)
    first[1:] = p[1:] > end[:-1]
    starts = np.flatnonzero(first)
    return list(zip(p[starts].tolist(), end[np.append(starts[1:], len(p)) - 1].tolist()))


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Contract rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256). Texts meet their runs by 64 bits of id and
    text and by their length."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    source = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_k"), F.octet_length(text).cast("bigint").alias("n"), text.alias("_t"))
    with scratch():
        runs = repeated_runs(source, size, gram).groupBy("_k", "n").agg(F.collect_list(F.struct("p1", "more")).alias("runs"))
        runs = stage(runs, "sub-runs", keep=True)
    id_type, keys = dict(source.dtypes)["doc_id"], small_side(runs.select("_k", "n"), KEY_ROWS)
    # texts without a run stay where they are while the keys of the others are few enough to broadcast
    whole = source.join(keys, ["_k", "n"], "left_anti").withColumn("runs", F.lit(None).cast("array<struct<p1: bigint, more: int>>"))
    cut = source.join(keys, ["_k", "n"], "left_semi").join(runs, ["_k", "n"])
    return in_arrow(whole.select("doc_id", "n", "_t", "runs").unionByName(cut.select("doc_id", "n", "_t", "runs")), _kept(size), f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
