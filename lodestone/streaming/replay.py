"""Streaming counterparts of incremental acquisition: idempotent replay, latest success, change points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collisions(known: DataFrame, batch: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """Rows of ``batch`` whose id is known with another digest."""
    k = known.select(F.col(id_col).alias("_id"), F.col(digest_col).alias("_d"))
    return batch.join(k, F.col(id_col) == F.col("_id")).where(F.col(digest_col) != F.col("_d")).drop("_id", "_d")


def append_new(known: DataFrame, batch: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``batch`` with unknown ids, once each."""
    fresh = batch.join(known.select(F.col(id_col).alias("_id")), F.col(id_col) == F.col("_id"), "left_anti")
    return fresh.dropDuplicates([id_col])


def replay_into(stream: DataFrame, path: str, checkpoint: str, id_col: str, digest_col: str):
    """Append a stream to the Parquet table at ``path``: replays add nothing, a changed payload under a known
    id fails the batch. ``availableNow`` runs to the end of what is there and returns the finished query."""
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)  # any other failure fails the batch
        known = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
        if not collisions(known, batch, id_col, digest_col).isEmpty():
            raise ValueError("a known id came with another payload")
        append_new(known, batch, id_col).write.mode("append").parquet(path)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest_success(rows: DataFrame, key: str, ok: Column, order: list[Column]) -> DataFrame:
    """A later failure does not delete: the last successful row of each key."""
    return rows.where(ok).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)])).alias("_r")).select(key, "_r.*")


def change_points(rows: DataFrame, key: str, value: Column, order: list[Column]) -> DataFrame:
    """Rows whose value differs from the one before, and each key's first."""
    prev = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return rows.withColumns({"_prev": prev, "_first": first}).where(F.col("_first") | ~value.eqNullSafe(F.col("_prev"))).drop("_prev", "_first")
