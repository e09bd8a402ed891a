"""Shared helpers: table access, staging in the shared folder, checked broadcasts, components."""

from __future__ import annotations

import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a keyed side table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: The same for tables of keys alone, of at most about 100 bytes a row in memory.
KEY_ROWS = 1_000_000

_SCOPES = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches to Python workers hold at most so many rows and bytes (a longer row stands alone), where the
#: session has not chosen sizes of its own: both sides of the pipe keep a few batches of each running task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in bounded batches."""
    chosen = df.sparkSession._jsparkSession.sessionState().conf()
    for key, value in BATCH.items():
        if not chosen.contains(key):
            df.sparkSession.conf.set(key, value)
    return df.mapInArrow(run, schema)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of id and text: rows with equal id and text share it, others meet with probability 2**-128."""
    name, text = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (id_col, text_col))
    return F.unhex(F.md5(F.concat(F.md5(name), text)))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share; a temporary one only in local mode where the session names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for those staged with ``keep``."""
    scopes = _SCOPES.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        for df in scopes.pop():
            unstage(df)


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read and not a recomputation. ``keep``: the table outlives the innermost ``scratch``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    scopes = getattr(_SCOPES, "open", [])[: -1 if keep else None]
    if scopes:
        scopes[-1].append(out)
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing still to be computed reads (what came of it is staged itself)."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs now: Spark deletes them once the driver's JVM has collected the
    plans that made them, which a driver with much free memory may not do for a long time. The first collection
    ends what Python and the listeners held, the second the plans."""
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.7)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, for small loop state."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if ``df`` has at most ``limit`` rows (a bounded count), else unchanged.
    ``df`` must be staged: it is counted here and read again by the join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_mark(df: DataFrame, limit: int = KEY_ROWS) -> Callable[[DataFrame], DataFrame]:
    """What ``small_side`` would do with tables of as many rows as the staged ``df``, counted once."""
    return F.broadcast if df.limit(limit + 1).count() <= limit else lambda x: x


#: Rows of one key from which it counts as hot.
HOT = 1000


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``side``, which is staged and has one row per key with the key's
    ``count`` of rows: hot keys, at most a thousandth of the rows, are broadcast, so that their rows stay dealt as
    they are; the others meet by shuffle."""
    hot, rest = side.where(F.col(count) >= HOT), side.where(F.col(count) < HOT)
    if hot.isEmpty():
        return rows.join(side, keys, how)
    near = rows.join(small_side(hot, KEY_ROWS), keys)
    far = rows.join(small_side(hot.select(*keys), KEY_ROWS), keys, "left_anti").join(rest, keys, how)
    return near.unionByName(far)


def components(edges: DataFrame, label: str = "cc", known: DataFrame | None = None) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (v, l), l the least vertex of v's component.

    Min-label propagation with pointer jumping; all state stays distributed, each round is staged and moves the
    edges once (labels of up to KEY_ROWS vertices are broadcast, so that a hub's edges need not meet in a task;
    more are joined by shuffle). ``known`` has the components of earlier edges: then only labels that ``edges``
    joins anew go through the rounds.
    """
    ends = edges.select("a", "b")
    if known is not None:
        mark = small_mark(known)
        la, lb = (mark(known.select(F.col("v").alias(c), F.col("l").alias(f"l{c}"))) for c in ("a", "b"))
        ends = ends.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    e = stage(ends.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), back)).alias("e")).select("e.*").distinct(), f"{label}-edges")
    if known is not None and e.isEmpty():
        return known
    labels = stage(e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("l")), f"{label}-0")
    mark, step, moved = small_mark(labels), 0, True
    while moved:
        # every vertex is some edge's a: its neighbours' least label, its own, and the label of that label
        step += 1
        own, up = mark(labels.select(F.col("v").alias("o"), F.col("l").alias("ol"))), mark(labels.select(F.col("v").alias("u"), F.col("l").alias("ul")))
        near = e.join(mark(labels), e.b == labels.v).groupBy("a").agg(F.min("l").alias("m"))
        hooked = near.join(own, near.a == own.o).select(F.col("a").alias("v"), F.col("ol").alias("l"), F.least("ol", "m").alias("h"))
        jumped = hooked.join(up, F.col("h") == F.col("u"), "left")
        new = stage(jumped.select("v", F.least("h", "ul").alias("l"), (F.least("h", "ul") != F.col("l")).alias("moved")), f"{label}-{step}")
        labels, moved = new.select("v", "l"), not new.where("moved").isEmpty()
    if known is None:
        return labels
    joined = mark(labels.select(F.col("v").alias("u"), F.col("l").alias("ul")))
    old = known.join(joined, F.col("l") == F.col("u"), "left").select("v", F.coalesce("ul", "l").alias("l"))
    return stage(old.unionByName(labels.join(known.select("v"), "v", "left_anti")), f"{label}-all")
