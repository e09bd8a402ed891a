"""The inbox: where every connector's envelopes arrive, with keyed state instead of a look at all that came before.

The first envelope of an id is new; the same id with the same digest is a replay and changes nothing; the same id
with another digest is a collision and fails the batch before anything of it is written. The state, in the stream's
checkpoint folder, holds numbers for an id and no envelope, so a batch costs what it brings, however much is there
already. The envelopes pass beside it, and those of new ids are picked from their batch.

* Envelopes without an id are refused: the batch fails. Several envelopes of one id in a batch are taken in the
  order of (observed_at, digest), nulls first; the first decides.
* A batch that is run again (after a failure) writes over its own folder, so it adds nothing twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.connector import ConnectorError, Descriptor, RunReport, opened

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_SEEN, _CAME = "inbox", "came"
_BEFORE = -(1 << 63)  # the time of what is known: before all batches


def accept(envelopes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """For each id that a batch brings, whether it is ``new`` with this batch and whether it is a ``collision``.
    ``known`` is a stream of envelopes that count as there before, whenever they arrive.

    The state is an aggregate of numbers, so it is kept and combined without Python, by hash and in place: the first and
    last batch of an id and the least and greatest of its digests, each in four parts. Batches are told apart by their
    time, which a batch that is run again keeps."""
    spark = envelopes.sparkSession
    if "RocksDB" not in (spark.conf.get(_PROVIDER, None) or ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    rows = envelopes.observe(_SEEN, F.count(F.lit(1)).alias("n")).select("id", "digest", F.unix_micros(F.current_timestamp()).alias("at"))
    if known is not None:
        rows = rows.unionByName(known.select("id", "digest", F.lit(_BEFORE).alias("at")))
    hashed, parts = F.sha2(F.col("digest").cast("binary"), 256), [f"p{k}" for k in range(4)]
    rows = rows.select("id", "at", *[F.conv(F.substring(hashed, 16 * k + 1, 16), 16, -10).cast("bigint").alias(p) for k, p in enumerate(parts)])
    held = rows.groupBy("id").agg(*[f(c).alias(f"{name}_{c}") for name, f in (("lo", F.min), ("hi", F.max)) for c in ("at", *parts)])
    new = (F.col("lo_at") == F.col("hi_at")) & (F.col("lo_at") != _BEFORE)
    return held.select("id", new.alias("new"), reduce(or_, [F.col(f"lo_{p}") != F.col(f"hi_{p}") for p in parts]).alias("collision"))


def _drained(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str, mode: str) -> tuple[int, int, bytes | None]:
    """Run a stream to the end of what is there: rows that its first source gave (or that came, where the stream
    observes that, since a source that is read twice counts twice), rows that were seen where the stream observes them,
    and the connector's last checkpoint. A query remembers its last hundred steps only, so they are counted on the way."""
    steps: dict[int, tuple[int, int]] = {}
    started: list = []

    def note() -> None:
        for p in started[0].recentProgress if started else ():
            came, seen = (p["observedMetrics"].get(x) for x in (_CAME, _SEEN))
            if p["sources"][0]["numInputRows"]:
                steps[p["batchId"]] = came["n"] if came else p["sources"][0]["numInputRows"], seen["n"] if seen else 0

    def each(batch: DataFrame, epoch: int) -> None:
        if epoch % 50 == 49:
            note()
        write(batch, epoch)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", state).outputMode(mode).start()
    started.append(query)
    try:
        query.processAllAvailable()
        note()
        last = json.loads(query._jsq.lastProgress().json()) if query.lastProgress else None
    finally:
        query.stop()
    return sum(x for x, _ in steps.values()), sum(x for _, x in steps.values()), opened(last["sources"][0]["endOffset"]) if last else None


def run_connector(spark: SparkSession, descriptor: Descriptor, envelopes: DataFrame, inbox: str, state: str, coverage: str = "incremental", restart: bool = False) -> RunReport:
    """One run: all that the connector has by now goes into the Parquet table ``inbox``; ``state`` keeps the
    checkpoint and what is known. The next run goes on where this one ended. ``restart``: the connector begins again
    with its first checkpoint, as it does when it lost its own; what is known then comes from the inbox."""
    added = 0
    known = _known(spark, inbox) if restart else None
    if restart:
        state = f"{state}-{uuid.uuid4().hex}"
    target = f"{inbox}/run={state.rstrip('/').rpartition('/')[2]}"

    first = F.struct("observed_at", "digest", *(c for c in envelopes.columns if c not in ("id", "observed_at", "digest"))).alias("first")
    came = envelopes.observe(_CAME, F.count(F.lit(1)).alias("n")).select("id", first)

    def write(batch: DataFrame, epoch: int) -> None:
        nonlocal added
        batch = batch.persist()
        try:
            new, rows, collisions, nameless = batch.agg(F.count_if("new"), F.count("first"), F.count_if("collision"), F.count_if(F.col("id").isNull())).first()
            if collisions or nameless:
                raise ConnectorError("an envelope has no id" if nameless else "a known id came with another payload")
            # envelopes move only where new ids stand beside known ones or have several
            firsts = batch.where("first is not null") if new == rows else batch.where(F.lit(new > 0)).groupBy("id").agg(F.min("first").alias("first"), F.max("new").alias("new")).where("new")
            firsts.select(*(c if c == "id" else f"first.{c}" for c in envelopes.columns)).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/epoch={epoch}")
            added += new
        finally:
            batch.unpersist()

    stream = came.unionByName(accept(envelopes, known), allowMissingColumns=True)
    emitted, seen, checkpoint = _drained(stream, write, state, "update")
    return RunReport(coverage, emitted, added, seen - added, checkpoint).checked(descriptor)


def _known(spark: SparkSession, inbox: str) -> DataFrame:
    """What the runs so far have put into the inbox, as a stream of its own."""
    root = spark._jvm.org.apache.hadoop.fs.Path(inbox)
    runs = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root) if s.isDirectory()]
    return spark.readStream.schema(received(spark, inbox).schema).parquet(f"{inbox}/{{{','.join(runs)}}}/epoch=*")


def received(spark: SparkSession, inbox: str) -> DataFrame:
    return spark.read.parquet(inbox).drop("run", "epoch")


# --- latest success


def _best(rows: DataFrame, digest: str = "digest") -> DataFrame:
    """The latest row of each locator; ids that are numbers count as such among rows of one time."""
    return rows.groupBy("locator").agg(F.max(F.struct("observed_at", F.length("id").alias("len"), "id", digest)).alias("b")).select("locator", "b.observed_at", "b.id", "b.digest")


def run_latest(envelopes: DataFrame, target: str, state: str) -> int:
    """A later failure does not delete: keep the latest success of each locator. The stream's state is one row a
    locator; rows are combined before they are dealt, so a busy locator is no burden. Each step writes the locators
    that it changed; returns the rows read."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return _drained(_best(envelopes.where("outcome = 'success'")), write, state, "update")[0]


def latest(spark: SparkSession, target: str) -> DataFrame:
    """(locator, observed_at, id, digest) after all steps."""
    return _best(spark.read.parquet(target))
