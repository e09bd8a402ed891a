"""Bounded reachability and components over edge lists."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder the session names (a temporary one only in local mode if it names none)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): distinct nodes reached along src -> dst within ``depth`` steps, each at every
    depth it is met. Each step is deduplicated, so parallel edges and diamonds do not multiply rows."""
    level = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct())
    out = level
    for d in range(1, depth + 1):
        level = cut(level.join(edges, level.node == edges.src).select("start", F.col("dst").alias("node"), F.lit(d).alias("depth")).distinct())
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node of each connected component of src - dst; loops give no node.

    Rounds of contraction: each node takes its least neighbour if that is smaller and follows such choices up to four
    steps; the edges move to where their ends went, with a link for each end of a walk that goes on. Edges within one
    end leave, so the edges shrink with every round instead of being read whole. A hub costs one combined minimum."""
    e, went = cut(edges.select("src", "dst").where("src <> dst")), []
    while not went or not e.isEmpty():
        both = e.union(e.select("dst", "src"))
        up = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("top")))
        end = up
        for k in range(3):
            end = end.join(up.toDF(f"n{k}", f"t{k}"), F.col("top") == F.col(f"n{k}")).select("node", F.col(f"t{k}").alias("top"))
        end = cut(end)
        went.append(end)
        src, dst, on = end.toDF("src", "a"), end.toDF("dst", "b"), end.toDF("on", "b")
        moved = e.join(src, "src").join(dst, "dst").select("a", "b")
        walks = end.select(F.col("top").alias("a")).distinct().join(on, F.col("a") == F.col("on")).select("a", "b")
        e = cut(moved.union(walks).where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    label = went[0].toDF("node", "component")
    for end in went[1:]:
        label = label.join(end.toDF("at", "to"), F.col("component") == F.col("at"), "left").select("node", F.coalesce("to", "component").alias("component"))
    return label
