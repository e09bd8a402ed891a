"""Product codes of integer vectors by weighted Lloyd rounds over distinct parts.

Vectors become integers (floor of ``scale`` times the component) and are cut into equal parts. Equal parts of a
position are one row with a weight, so a vector that a third of the rows repeat costs one row a position. Each
round assigns the distinct rows to their nearest entry and adds up weighted sums in the tasks; only these sums,
``parts`` x ``entries`` of them, reach the driver and only the codebooks, as many, go out. At the end codes and
errors of the distinct rows are joined back to the vectors by position and a 64-bit identifier of the part, whose
seed is chosen anew until no two distinct parts of a position share one. Parts that many vectors hold are met by
broadcast (checked in size), so that their vectors stay dealt as they are.

* Vectors that are null or hold null or non-finite components are dropped, and so are those whose length is not
  that of the kept vector with the smallest id among those of a length that ``parts`` divides.
* Integers outside the long range count as its ends, and so do errors. Nearest entries are exact at any size.
* The first codebooks are parts of the ``entries`` smallest ids (ties: smaller vector; null ids last), of fewer if
  there are fewer. Rows that repeat, and repeated ids, are rows of their own. Null labels are one label.
* An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, scratch, spread_join, stage

_LONG = (1 << 63) - 1
#: Integers below this in magnitude have squared distances of up to 128 components within 64 bits.
_SAFE = 1 << 27


def _integers(vector: str, scale: int) -> Column:
    low, high = F.lit(-(2.0**63)), F.lit(2.0**63)
    one = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, low), high))
    return F.transform(vector, one)


def _finite(vector: str) -> Column:
    big = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < big))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: lowest) and the squared distance, for each row of ``x``."""
    if max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), max((abs(int(v)) for v in book.flat), default=0)) >= _SAFE or x.shape[1] > 128:
        x, book = x.astype(object), book.astype(object)
    far = ((x[:, None, :] - book[None]) ** 2).sum(-1) if x.shape[1] else np.zeros((len(x), len(book)), np.int64)
    at = np.array([min(range(len(book)), key=row.__getitem__) for row in far]) if far.dtype == object else far.argmin(1)
    return at, far[np.arange(len(x)), at]


def _by_position(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    pos = batch.column("pos").to_numpy()
    values = batch.column("part").flatten().to_numpy(zero_copy_only=False).reshape(len(pos), width)
    for p in np.unique(pos):
        rows = np.flatnonzero(pos == p)
        yield int(p), rows, values[rows]


def _sums(books: list[np.ndarray], width: int):
    """Weighted counts (c = -1) and component sums of each entry's rows, one set a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for p, rows, x in _by_position(batch, width):
                at, _ = nearest(x, books[p])
                w = weights[rows].astype(object)
                for entry in np.unique(at):
                    mine = at == entry
                    for c, s in enumerate([w[mine].sum(), *(w[mine][:, None] * x[mine].astype(object)).sum(0)], -1):
                        total[p, int(entry), c] = total.get((p, int(entry), c), 0) + int(s)
        if total:
            p, e, c = zip(*total)
            yield pa.record_batch(
                {"pos": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "c": pa.array(c, pa.int32()), "s": pa.array(map(Decimal, total.values()), pa.decimal128(38, 0))}
            )

    return run


def _codes(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for p, rows, x in _by_position(batch, width):
                at, far = nearest(x, books[p])
                code[rows], error[rows] = at, np.minimum(far, _LONG).astype(np.int64)
            yield pa.record_batch([batch.column("pos"), batch.column("h"), batch.column("weight"), pa.array(code), pa.array(error)], ["pos", "h", "weight", "code", "err"])

    return run


def _clipped(total: Column) -> Column:
    return F.least(total, F.lit(Decimal(_LONG)).cast("decimal(38,0)")).cast("bigint")


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(id, label, codes as array, code, error, label_error, codebooks_sha256) of every kept vector."""
    if not 1 <= entries <= 16 or not 1 <= parts <= 15:
        raise ValueError("codes are one byte a part in a long: at most 16 entries and 15 parts")
    spark, fields = vectors.sparkSession, vectors.schema
    kept = vectors.where(_finite(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), _integers(vector_col, scale).alias("v"))
    kept = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    by_id = [F.col("id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*by_id).limit(1).collect()
    if not first:
        empty = f"{id_col} {fields[id_col].dataType.simpleString()}, {label_col} {fields[label_col].dataType.simpleString()}"
        return spark.createDataFrame([], f"{empty}, codes array<int>, code string, error bigint, label_error bigint, codebooks_sha256 string")
    length = len(first[0]["v"])
    width = length // parts
    kept = kept.where(F.size("v") == length)
    start = np.array([r["v"] for r in kept.orderBy(*by_id).limit(entries).collect()], object)
    books = [start[:, p * width : (p + 1) * width].astype(np.int64) for p in range(parts)]
    cut = F.array(*(F.slice("v", p * width + 1, width) for p in range(parts)))
    with scratch():
        distinct = kept.select(F.posexplode(cut).alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("weight"))
        distinct = stage(distinct, "codes-distinct")
        seed = 0
        while not distinct.groupBy("pos", F.xxhash64(F.lit(seed), "part")).count().where("count > 1").isEmpty():
            seed += 1
        distinct = distinct.withColumn("h", F.xxhash64(F.lit(seed), "part"))
        for _ in range(rounds):
            sums = in_arrow(distinct.select("pos", "part", "weight"), _sums(books, width), "pos int, entry int, c int, s decimal(38,0)")
            got = {(r["pos"], r["entry"], r["c"]): int(r["s"]) for r in sums.groupBy("pos", "entry", "c").agg(F.sum("s").alias("s")).collect()}
            for p, entry, c in got:
                if c >= 0:
                    books[p][entry, c] = got[p, entry, c] // got[p, entry, -1]
        coded = in_arrow(distinct.select("pos", "part", "weight", "h"), _codes(books, width), "pos int, h bigint, weight bigint, code bigint, err bigint")
        coded = stage(coded, "codes-coded")
        own = stage(kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform(cut, lambda x: F.xxhash64(F.lit(seed), x)).alias("hs")), "codes-rows")
        met = spread_join(own.select("row", "id", "label", F.posexplode("hs").alias("pos", "h")), coded, ["pos", "h"], "weight")
        place = F.col("code") * F.element_at(F.array(*(F.lit(16**k) for k in reversed(range(parts)))), F.col("pos") + 1)
        rows = met.groupBy("row", "id", "label").agg(F.sum(place).alias("packed"), _clipped(F.sum(F.col("err").cast("decimal(38,0)"))).alias("error"))
        rows = rows.withColumn("label_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-")))
        rows = stage(rows.drop("row"), "codes-vectors", keep=True)
        labels = rows.groupBy("label_key").agg(_clipped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count("*").alias("n"))
        labels = stage(labels, "codes-labels", keep=True)
    digest = hashlib.sha256(",".join(str(int(v)) for book in books for v in book.flat).encode()).hexdigest()
    digits = F.lpad(F.lower(F.hex("packed")), parts, "0")
    codes = F.array(*(F.conv(F.substring(digits, p + 1, 1), 16, 10).cast("int") for p in range(parts)))
    return spread_join(rows, labels, ["label_key"], "n").select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), codes.alias("codes"),
        F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error", "label_error", F.lit(digest).alias("codebooks_sha256"),
    )
