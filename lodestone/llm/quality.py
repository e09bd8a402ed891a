"""Quality classifier: a sparse rule ensemble over text statistics.

A vectorised pass computes statistics of whole texts. Boosted shallow trees on the labelled rows
give decision paths; each path is a conjunction of threshold tests, a rule. A lasso logistic regression
(accelerated proximal gradient) weighs the rules and most get weight zero; the rest compile into one
Spark column expression over the statistics, so scoring is a projection without Python.

Only rows whose crc32(id as text) mod 3 is not 1 are learnt from, at most ``train_rows`` of them, those
with the least hash of their id: a documented bound, chosen alike at every size. Their ids are chosen first, so
only their statistics are computed for learning; then one pass over all texts scores them.

* Null and empty texts have all statistics 0 and get a score like any row.
* Very long texts are read in stretches of a few MB; what is held for one is 8 bytes a word (the word hashes).
* Labels that are null are not learnt; several labels of one document count by their mean (ties: 1); of several
  texts under one id the one with the least hash is learnt from.
* Without labels, or with one class only, the score is that class's (0.5 without labels).
* Repeated rows score alike; a null id is held out; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import in_arrow, scratch, stage
from .textnum import PIECE, U, _words, flat, lean, pieces, small, white_lut

TRAIN_ROWS = 20_000
STATS = ("words", "mean_len", "distinct", "repeat_prev", "top", "upper", "symbol", "digit", "pipe", "punct", "newline", "odd_end", "long_words", "short_words")


def _byte_kinds() -> np.ndarray:
    kind = np.zeros((6, 256), np.uint8)
    kind[0, 0x41:0x5B] = 1
    kind[1, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1
    kind[1, [ord(c) for c in ".,;:!?'\"-()"]] = 0
    kind[2, 0x30:0x3A] = 1
    kind[3, ord("|")] = 1
    kind[4, [ord(c) for c in ".,;:!?"]] = 1
    kind[5, 0x0A] = 1
    return kind


def _measured(data: np.ndarray, off: np.ndarray, lut: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums by byte kind and word measure, word hashes, their documents) of some documents or of a stretch of one."""
    m = len(off) - 1
    sums = np.zeros((10, m), np.int64)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return sums, np.zeros(0, U), np.zeros(0, np.int64)
    for k in range(6):
        sums[k, full] = np.add.reduceat(kind[k][data], off[:-1][full], dtype=np.int64)
    h, starts = _words(data, off[:-1], lut)
    doc = np.searchsorted(off, starts, side="right") - 1
    n = np.bincount(doc, minlength=m)
    has = np.flatnonzero(n)
    if len(has):
        # a word ends before the next separator; lengths in bytes without separators
        length = np.add.reduceat(lut[data] != 0, starts, dtype=np.int64)
        cuts = (np.cumsum(n) - n)[has]
        odd = kind[1][data[np.minimum(starts + length - 1, len(data) - 1)]]
        for k, x in enumerate((length, odd, length > 15, length < 3), 6):
            sums[k, has] = np.add.reduceat(x.astype(np.int64), cuts)
    return sums, h, doc


def _of_pieces(data: np.ndarray, off: np.ndarray, lut: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The statistics (one row each) of the documents between ``off``: a long document in stretches that end at separators."""
    m, size = len(off) - 1, np.diff(off)
    if m == 1 and size[0] > 2 * PIECE:
        sums, parts, at = np.zeros((10, 1), np.int64), [], 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data) and lut[data[end]] != 0:
                end += 1
            s, h, _ = _measured(data[at:end], np.array([0, end - at]), lut, kind)
            sums += s
            parts.append(h)
            at = end
        h = np.concatenate(parts)
        doc = np.zeros(len(h), np.int8)
    else:
        sums, h, doc = _measured(data, off, lut, kind)
    out = np.zeros((len(STATS), m))
    out[5:11] = sums[:6] / np.maximum(size, 1)
    n = np.bincount(doc, minlength=m)
    has = np.flatnonzero(n)
    if len(has):
        at = np.cumsum(n) - n
        cuts, w = at[has], n[has]
        same = np.zeros(len(h), np.int64)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[3, has] = np.add.reduceat(same, cuts) / w
        for a, b in zip(cuts, cuts + w):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        runs = np.flatnonzero(new)
        most = np.zeros(m, np.int64)
        np.maximum.at(most, doc[runs], np.diff(np.append(runs, len(h))))
        out[0, has] = w
        out[1, has] = sums[6, has] / w
        out[2, has] = np.add.reduceat(new.astype(np.int64), cuts) / w
        out[4, has] = most[has] / w
        for k, row in ((7, 11), (8, 12), (9, 13)):
            out[row, has] = sums[k, has] / w
    return out


def _statistics(batches: Iterator[pa.RecordBatch], text: int, ids: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns ``ids`` of each batch as they come, then the statistics of column ``text``."""
    lut, kind = white_lut(), _byte_kinds()
    for batch in small(batches, text):
        data, off = flat(batch.column(text))
        blocks = [_of_pieces(data[off[i] : off[j]], off[i : j + 1] - off[i], lut, kind) for i, j in pieces(off)]
        stats = np.concatenate(blocks, axis=1) if blocks else np.zeros((len(STATS), 0))
        yield pa.record_batch([batch.column(c) for c in ids] + [pa.array(row) for row in stats], names=names)


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and one double column per statistic."""
    source = docs.select(*keep, F.col(text_col).alias("_t"))
    ids, names = list(range(len(keep))), [*keep, *STATS]
    schema = StructType([*source.schema.fields[:-1], *[StructField(s, DoubleType()) for s in STATS]])
    return in_arrow(source, lambda batches: _statistics(batches, len(ids), ids, names), schema)


def learnable(id_col: Column, mod: int = 3, out: int = 1) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod != out, F.lit(False))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is above, threshold), all must hold


def _paths(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, bins: int = 32, rate: float = 0.3, seed: int = 7) -> list[Rule]:
    """Decision paths (inner nodes included) of gradient-boosted trees on binned statistics."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(f)]
    code = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") for k in range(f)])  # code > c means x > cuts[c]
    score, rules, rng = np.zeros(n), {}, np.random.default_rng(seed)

    def grow(rows: np.ndarray, path: Rule, left: int, use: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        best = (1e-6, -1, -1)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if left and len(rows) >= 20:
            for k in use:
                b = len(cuts[k]) + 1
                gs = np.cumsum(np.bincount(code[k, rows], g[rows], b))[:-1]
                hs = np.cumsum(np.bincount(code[k, rows], h[rows], b))[:-1]
                if len(gs):
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    c = int(gain.argmax())
                    if gain[c] > best[0] and 0 < (code[k, rows] > c).sum() < len(rows):
                        best = (gain[c], k, c)
        if path:
            rules.setdefault(path)
        if best[1] < 0:
            score[rows] += rate * total_g / (total_h + 1)
            return
        _, k, c = best
        above = code[k, rows] > c
        for side, part in ((True, rows[above]), (False, rows[~above])):
            grow(part, (*path, (int(k), side, float(cuts[k][c]))), left - 1, use, g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        use = rng.permutation(f)[: max(4, f * 2 // 3)]
        grow(np.arange(n), (), depth, use, y - p, np.maximum(p * (1 - p), 1e-6))
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in rule:
        out &= (x[:, k] > t) == above
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by FISTA; the last column is 1 for the intercept, which is free."""
    n, m = a.shape[0], a.shape[1] - 1
    v = np.ones(m + 1)
    for _ in range(20):  # largest singular value
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / max(np.linalg.norm(a @ v) ** 2, 1e-9)
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - step * (a.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[list[tuple[float, Rule]], float]:
    """Weighted rules and the intercept."""
    if not len(y):
        return [], 0.0
    if y.min() == y.max():
        return [], 30.0 if y[0] else -30.0
    rules = _paths(x, y)
    cover = np.ones((len(y), len(rules) + 1))
    for k, q in enumerate(rules):
        cover[:, k] = holds(q, x)
    w, b = _lasso(cover, y, penalty)
    return [(float(v), q) for v, q in zip(w, rules) if v != 0], b


def compile_rules(rules: list[tuple[float, Rule]], intercept: float) -> Column:
    total = F.lit(float(intercept))
    for weight, rule in rules:
        test = F.lit(True)
        for k, above, t in rule:
            test = test & (F.col(STATS[k]) > t if above else F.col(STATS[k]) <= t)
        total = total + F.when(test, float(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Column:
    """The score column over the statistics. Of ``docs`` only (doc_id, text) of the chosen rows is measured."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    there = docs.select("doc_id").where(learnable(F.col("doc_id"))).distinct()
    with scratch():
        chosen = there.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        chosen = stage(chosen, "quality-chosen")
        texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        measured = statistics(texts.withColumn("h", F.xxhash64("text")), keep=("doc_id", "y", "h"))
        rows = measured.groupBy("doc_id").agg(F.min_by(F.struct("y", *STATS), "h").alias("r")).select("doc_id", "r.*").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(zero_copy_only=False), kind="stable")
    x = np.stack([rows.column(s).to_numpy()[order] for s in STATS], axis=1) if rows.num_rows else np.zeros((0, len(STATS)))
    y = rows.column("y").to_numpy()[order].astype(float)
    del rows
    score = compile_rules(*fit_rules(x, y))
    lean()
    return score


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``."""
    score = learn(docs, labels, train_rows)
    out = statistics(docs).select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they are, extra ones and those with
    the names of statistics included. Nulls, empty and very long texts, ties, repeats and empty tables are as
    above: each row is judged by its text alone. A text passes through one Arrow batch, once."""
    score = learn(docs, labels)
    plain, stats = [f"c{k}" for k in range(len(docs.columns))], list(STATS)
    text = docs.columns.index("text")
    renamed = docs.toDF(*plain)
    schema = StructType([*renamed.schema.fields, *[StructField(s, DoubleType()) for s in stats]])
    judged = in_arrow(renamed, lambda batches: _statistics(batches, text, list(range(len(plain))), plain + stats), schema)
    return judged.where(score >= threshold).select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns)])
