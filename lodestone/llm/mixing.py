"""Mixing sources to target word counts by entropy balancing. DataFrame functions only.

Targets: the sources, in code point order (null last), weigh ``weights`` in turn and share all words;
a target stops at ``cap`` times its source's words and the excess goes to the others by weight.

Rates: among all document rates r with 0 <= r <= cap that give each source its target, the chosen ones
are closest to the present mix in relative entropy. Their dual is one convex problem in one multiplier
per source; the solution is r = min(cap, exp(multiplier * words / mean words)). The multipliers are found
by Newton steps on the logarithm of the constraint, kept inside a shrinking bracket, for all sources at
once over a histogram of (source, size): the loop's state is one row per source, and no document moves.

Copies: a rate is rounded up when a hash of the document's id (of its text without one) falls below its fraction plus its source's
correction. The correction is read off a histogram of 4096 buckets per source, so that rounding errors
cancel to within about one bucket (a 4096th of the source's words).

* Null text: size 0, never taken. A source without words has target 0.
* Null and repeated ids: rows are judged one by one; rows with one id round alike, rows without an id by their texts.
* Very long texts are counted where they stand and do not move. The bracket of a multiplier halves at least where
  a Newton step fails, so 60 steps settle it; what a multiplier still misses, the correction below makes up.
* An empty table gives an empty result. Extra columns are ignored.
* Ties in source names cannot arise: equal names are one source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch, small_side, stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


def _sum_before(col: str, w) -> Column:
    return F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size). One row per source: the window
    without a partition sorts as many rows as there are sources."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("limit") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("rest_weight", F.sum("weight").over(everything) - _sum_before("weight", fill))
    per = per.withColumn("level", (F.col("total") - _sum_before("limit", fill)) / F.col("rest_weight"))
    # water level: that of the first source, by limit per weight, whose limit is not below it (later
    # sources of the same ratio have lower levels)
    per = per.withColumn("water", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", (-F.col("level")).alias("low")))).over(everything)["low"] * -1)
    return per.select("source", "source_size", "weight", F.least("limit", F.col("weight") * F.coalesce("water", F.lit(math.inf))).alias("target"))


def multipliers(hist: DataFrame, goals: DataFrame, cap: float = 3.0, tolerance: float = 1e-7, rounds: int = 20) -> DataFrame:
    """(source, mean, lam, saturated) for rows hist(source, size > 0, n) and goals(source, target, ...)."""
    log_cap = math.log(cap)
    stats = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = goals.where("source_size > 0").join(stats, goals.source.eqNullSafe(stats.source)).drop(stats.source)
    state = state.select(
        "source", "target", "mean",
        (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("saturated"),
        F.lit(0.0).alias("lam"),
        F.when(F.col("target") >= F.col("source_size"), 0.0).alias("lo"),
        F.when(F.col("target") < F.col("source_size"), 0.0).otherwise(log_cap * F.col("mean") / F.col("least")).alias("hi"),
        F.lit(False).alias("done"),
    )
    state = cut(state)
    for _ in range(rounds):
        for _ in range(3):  # three Newton steps in one job
            at = hist.join(state.select(F.col("source").alias("s"), "mean", "lam"), F.col("source").eqNullSafe(F.col("s")))
            x = F.col("size") / F.col("mean")
            rate = F.exp(F.least(F.lit(log_cap), F.col("lam") * x))
            words = F.col("n") * F.col("size")
            got = at.groupBy("s").agg(  # decimal sums do not depend on the order of rows, so reruns agree
                F.sum((words * rate).cast("decimal(28,9)")).cast("double").alias("g"),
                F.sum(F.when(F.col("lam") * x < log_cap, words * x * rate).otherwise(0.0).cast("decimal(28,9)")).cast("double").alias("dg"),
            )
            over = F.col("g") > F.col("target")
            lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
            newton = F.col("lam") + F.try_divide(F.col("g"), F.col("dg")) * F.log(F.col("target") / F.col("g"))
            inside = newton.isNotNull() & (F.coalesce(newton > lo, newton.isNotNull())) & F.coalesce(newton < hi, newton.isNotNull())
            # without a lower bound yet the fallback is to double the multiplier away from zero
            step = F.when(inside, newton).otherwise(F.coalesce((lo + hi) / 2, 2 * F.col("lam") - 1))
            done = F.col("saturated") | (F.col("target") <= 0) | (F.abs(F.col("g") - F.col("target")) <= tolerance * F.col("target"))
            state = state.join(got, F.col("source").eqNullSafe(F.col("s"))).select(
                "source", "target", "mean", "saturated", F.when(done, F.col("lam")).otherwise(step).alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done")
            )
        state = cut(state)
        if state.where("not done").isEmpty():
            break
    return state.select("source", "mean", "lam", "saturated")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies, rate), one for each row of ``docs``."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    with scratch():
        sized, plan = _planned(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col)).alias("h")), weights, cap)
        done = _rounded(sized, plan, cap)
    return done.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), F.col("copies").cast("int").alias("copies"), "rate"
    )


def _planned(rows: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    sized = stage(rows, "mix-sizes", keep=True)
    hist = stage(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    goals = stage(targets(sized, weights, cap), "mix-targets")
    lam = multipliers(hist, goals, cap)
    return sized, stage(goals.join(lam.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-plan", keep=True)


def _rounded(sized: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    g = small_side(plan).withColumnRenamed("source", "s")
    rated = sized.join(g, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = (
        F.when((F.col("size") == 0) | F.col("lam").isNull() | (F.col("target") <= 0), 0.0)
        .when(F.col("saturated"), float(cap))
        .otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.lit(math.log(cap)), F.col("lam") * F.col("size") / F.col("mean")))))
    )
    rated = rated.withColumn("rate", rate)
    # v in (-1, 1): the document is rounded up where v < correction; whole rates have no choice
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    rated = rated.withColumn("low", F.floor("rate")).withColumn("v", F.when(F.col("rate") > F.col("low"), unit - (F.col("rate") - F.col("low"))))
    rated = rated.withColumn("bucket", F.floor((F.col("v") + 1) * (BUCKETS / 2)))
    masses = rated.groupBy("source", "bucket").agg(F.sum("size").alias("mass"), F.sum(F.col("low") * F.col("size")).alias("base"))
    masses = masses.join(g.select("s", "target"), F.col("source").eqNullSafe(F.col("s")))
    total_base = F.sum("base").over(Window.partitionBy("s"))
    upto = F.sum(F.when(F.col("bucket").isNotNull(), F.col("mass")).otherwise(0)).over(Window.partitionBy("s").orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    gap = F.abs(total_base + upto - F.col("target"))
    best = masses.withColumn("gap", gap).groupBy(F.col("s").alias("src")).agg(F.min_by(F.coalesce("bucket", F.lit(-1)), F.struct("gap", F.coalesce("bucket", F.lit(-1)))).alias("last"))
    best = small_side(stage(best, "mix-correction", keep=True))
    done = rated.join(best, F.col("source").eqNullSafe(F.col("src")), "left")
    return done.withColumn("copies", F.col("low") + F.when(F.col("bucket") <= F.col("last"), 1).otherwise(0))
