"""Promotion of derived claims: lineage must cover the evidence, and restriction is inherited along derivations.

* Coverage is a relational division: a claim is covered if each of its active supporting evidence rows lies inside
  some target of its derivation's lineage. It is decided by one join on (derivation, source) and one aggregate.
* Restriction runs down the derivation graph, from restricted sources through every derivation that used them, to a
  fixed point. Each round moves only what the last one added, and is cut into the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut


def inherited(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): the seeds and every node that is reached from them along ``edges`` (src -> dst), each once.

    Cycles end, as a node is added once. Null nodes are none."""
    found = cut(seeds.select("node").where("node is not null").distinct())
    new = found
    while True:
        step = new.join(edges.select("src", "dst").where("dst is not null"), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = cut(step.join(found, "node", "left_anti"))
        if new.isEmpty():
            return found
        found = cut(found.unionByName(new))


def coverage(evidence: DataFrame, lineage: DataFrame, inside: Column) -> DataFrame:
    """(claim, needed, covered): how many active supporting evidence rows a claim has, and how many of them lie
    inside a lineage target of its derivation.

    ``evidence``: claim, derivation, evidence, source, relation, lifecycle and what ``inside`` reads; ``lineage``:
    derivation, source and what ``inside`` reads of the target. A source of one derivation has few targets; the
    join is dealt by both."""
    need = evidence.where((F.col("relation") == "supports") & (F.col("lifecycle") == "active"))
    targets = lineage.withColumnsRenamed({"derivation": "l_derivation", "source": "l_source"})
    met = need.join(targets, (F.col("derivation") == F.col("l_derivation")) & (F.col("source") == F.col("l_source")), "left")
    each = met.groupBy("claim", "evidence").agg(F.max(F.coalesce(inside, F.lit(False))).alias("inside"))
    return each.groupBy("claim").agg(F.count("*").alias("needed"), F.count_if("inside").alias("covered"))


def promotions(claims: DataFrame, evidence: DataFrame, lineage: DataFrame, inside: Column, uses: DataFrame, restricted: DataFrame) -> DataFrame:
    """(claim, problem): the first reason why a claim cannot be promoted, null if it can.

    ``claims``: claim, derivation, available, lineage_state, lifecycle; ``uses``: (src, dst) of derivations and what
    they used; ``restricted``: nodes that are restricted themselves, sources and derivations alike."""
    closed = inherited(uses, restricted)
    has_lineage = lineage.select("derivation").distinct().withColumn("has_lineage", F.lit(True))
    tainted = closed.select(F.col("node").alias("derivation")).withColumn("tainted", F.lit(True))
    bad_source = evidence.join(closed.select(F.col("node").alias("source")), "source", "left_semi").select("claim").distinct().withColumn("restricted_evidence", F.lit(True))
    out = claims.join(has_lineage, "derivation", "left").join(tainted, "derivation", "left").join(coverage(evidence, lineage, inside), "claim", "left").join(bad_source, "claim", "left")
    free = F.coalesce(F.col("lifecycle") != "restricted", F.lit(True))
    problem = (
        F.when(~F.coalesce("available", F.lit(False)), "origin_unavailable")
        .when(F.col("lineage_state").isin("exact", "partial") & F.col("has_lineage").isNull(), "lineage_missing")
        .when(F.col("tainted") & free, "restricted_input")
        .when(F.col("covered") < F.col("needed"), "evidence_not_covered")
        .when(F.col("restricted_evidence") & free, "restricted_evidence")
    )
    return out.select("claim", problem.alias("problem"))
