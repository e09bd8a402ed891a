"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the session's checkpoint folder (a temporary one only in local mode if it names none)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return f"{sc.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


#: Arrow batches to Python workers hold at most so many rows and bytes (a longer row stands alone), where the session
#: has not chosen sizes of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, of which Python workers get small batches: what they hold is then that of a few texts."""
    chosen = df.sparkSession._jsparkSession.sessionState().conf()
    for key, value in BATCH.items():
        if not chosen.contains(key):
            df.sparkSession.conf.set(key, value)
    return df
