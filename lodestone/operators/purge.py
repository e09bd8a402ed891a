"""Purges: the payload of purged records goes, and bytes go with the last record that owns them.

An object (stored bytes) has owners of several kinds. A purge lists owners; an object's bytes are deleted if no
owner outside the purge is left, else they stay and only the owners' payload is scrubbed. What is to happen is
written down first (the manifest), then carried out, and what the manifest says can be held against what is there.
Owners are counted per object before anything moves, so an object that a third of the records share is no burden.

* An owner without an object is scrubbed only. A request for an unknown owner changes nothing and is not listed.
* Requests that repeat count once. A null owner id is no owner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OWNER = ["kind", "owner"]


def owners(**kinds: DataFrame) -> DataFrame:
    """(kind, owner, object) of several tables of (owner, object)."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col("owner").cast("string").alias("owner"), "object") for kind, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts).where("owner is not null")


def object_fates(owned: DataFrame, requests: DataFrame) -> DataFrame:
    """(object, purged, living, action) of each object that a purged owner has: delete_bytes or keep_shared."""
    asked = requests.select(*OWNER).distinct().withColumn("asked", F.lit(True))
    marked = owned.where("object is not null").select(*OWNER, "object").distinct().join(asked, OWNER, "left")
    fate = marked.groupBy("object").agg(F.count_if("asked").alias("purged"), F.count_if(F.col("asked").isNull()).alias("living")).where("purged > 0")
    return fate.withColumn("action", F.when(F.col("living") == 0, "delete_bytes").otherwise("keep_shared"))


def manifest(purge: str, owned: DataFrame, requests: DataFrame) -> DataFrame:
    """(purge, kind, id, action): one row for each record to scrub and each object whose bytes are to go."""
    scrub = owned.select(*OWNER).distinct().join(requests.select(*OWNER).distinct(), OWNER).select("kind", F.col("owner").alias("id"), F.lit("scrub_payload").alias("action"))
    bytes_ = object_fates(owned, requests).where("action = 'delete_bytes'").select(F.lit("object").alias("kind"), F.col("object").alias("id"), "action")
    return scrub.unionByName(bytes_).select(F.lit(purge).alias("purge"), "kind", "id", "action")


def scrubbed(rows: DataFrame, kind: str, id_col: str, payload: list[str], plan: DataFrame) -> DataFrame:
    """``rows`` of one kind with null payload where the manifest says so."""
    gone = plan.where((F.col("kind") == kind) & (F.col("action") == "scrub_payload")).select(F.col("id").alias("_purged")).distinct()
    met = rows.join(gone, F.col(id_col).cast("string") == F.col("_purged"), "left")
    return met.select(*(F.when(F.col("_purged").isNull(), F.col(c)).alias(c) if c in payload else F.col(c) for c in rows.columns))


def without_bytes(objects: DataFrame, plan: DataFrame, key: str = "object") -> DataFrame:
    """The objects whose bytes stay."""
    gone = plan.where("action = 'delete_bytes'").select(F.col("id").alias(key)).distinct()
    return objects.join(gone, key, "left_anti")


def incomplete(plan: DataFrame, owned: DataFrame, objects: DataFrame) -> DataFrame:
    """(kind, id, problem): where the state after a purge differs from its manifest.

    ``owned``: kind, owner, object now, payload (whether some is left); ``objects``: object (whose bytes are there)."""
    scrub = plan.where("action = 'scrub_payload'").select("kind", F.col("id").alias("owner")).distinct()
    kept = owned.join(scrub, OWNER, "left_semi").where("payload").select("kind", F.col("owner").alias("id"), F.lit("payload_left").alias("problem"))
    here = objects.select("object").distinct().withColumn("there", F.lit(True))
    deleted = plan.where("action = 'delete_bytes'").select(F.col("id").alias("object")).distinct()
    left = deleted.join(here, "object", "left_semi").select(F.lit("object").alias("kind"), F.col("object").alias("id"), F.lit("bytes_left").alias("problem"))
    needed = owned.join(scrub, OWNER, "left_anti").where("object is not null").join(here, "object", "left_anti")
    lost = needed.select("kind", F.col("owner").alias("id"), F.lit("shared_bytes_lost").alias("problem"))
    return kept.unionByName(left).unionByName(lost)
