"""Relational operators of the record store: revision chains, lookups, reconciliation, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .graph import cut


def current(revisions: DataFrame, id_col: str, supersedes_col: str) -> DataFrame:
    """Revisions that no other revision supersedes."""
    gone = revisions.where(F.col(supersedes_col).isNotNull()).select(F.col(supersedes_col).alias("_gone"))
    return revisions.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by ``order`` (a total order): an aggregate, so it combines map-side."""
    packed = F.max_by(F.struct(*rows.columns), F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)]))
    return rows.groupBy(*keys).agg(packed.alias("_r")).select("_r.*")


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Dictionary semantics: of several rows with one key the last stays."""
    return latest_per_key(rows, [key], [F.col(position)])


def revision_history(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Each row's number in its chain, its predecessor's id (column ``id``) and whether it is current."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"revision_no": F.row_number().over(w), "supersedes": F.lag("id").over(w), "is_current": F.lead("id").over(w).isNull()})


def carry_forward(rows: DataFrame, value: Column, keys: list[str], order: list[Column]) -> Column:
    """The last non-null ``value`` up to each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of both sides with their status: both, missing (left only) or extra (right only)."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").otherwise("both")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def duplicates(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Keys that occur more than once, with their count and first id."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def other_end(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Both orientations of an undirected edge list as (node, other)."""
    return edges.select(F.col(src).alias("node"), F.col(dst).alias("other")).unionByName(edges.select(F.col(dst).alias("node"), F.col(src).alias("other")))


def shared_pairs(items: DataFrame, item: str, feature: str, min_shared: int, min_jaccard: float, hot: int = 1000) -> DataFrame:
    """Pairs of items with at least ``min_shared`` common features or Jaccard >= ``min_jaccard``.
    ``items`` has one row per item and distinct feature; pairs come from an equi-join on the feature.

    A partner of an item of n features shares at least ``need`` = min(min_shared, ceil(min_jaccard * n)) of them, so
    the item's need - 1 most frequent features make no pair alone. Those that more than ``hot`` items have are its
    tail: two tails do not meet in the join, what they share is counted from the tails of a pair that met elsewhere.
    So a feature in the tail of all its items meets none. ``hot`` decides the plan, not the rows."""
    rows = cut(items.select(F.col(item).alias("_i"), F.col(feature).alias("_f")))
    sizes = cut(rows.groupBy("_i").agg(F.count("*").alias("_n")))
    counts = rows.groupBy("_f").agg(F.count("*").alias("_c"))
    most, twice = counts.agg(F.coalesce(F.max("_c"), F.lit(0)), F.coalesce(F.sum(F.col("_c") * (F.col("_c") - 1)), F.lit(0))).first()
    if most <= hot:
        met = _met_by_lists(rows, sizes, twice // 2)
    else:
        met = _met_by_heads(rows, sizes, counts.where(F.col("_c") > hot), min_shared, min_jaccard)
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return met.select("a", "b", "shared", jaccard.alias("jaccard")).where((F.col("shared") >= min_shared) | (F.col("jaccard") >= min_jaccard))


def _narrowed(lo: int | None, hi: int | None, of: str) -> str:
    """The narrowest integral type, at most ``of``, that holds ``lo`` to ``hi``."""
    return next((t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)) if lo is not None and -(1 << bits) <= lo and hi < 1 << bits), of)


def _met_by_lists(rows: DataFrame, sizes: DataFrame, pairs: int) -> DataFrame:
    """(a, b, na, nb, shared) of all pairs, where no feature has many items; ``pairs`` is how often two items meet.

    Meetings are by far the most rows, so they move once and packed: an item gets, for each of its features, the list of
    the items after it in the order of (size, item), and meets them where it is counted. That order lets the item of
    fewer features count, so a hub counts with other hubs only. Tasks are as many as the meetings ask for, so that
    they are counted in memory."""
    kind = rows.schema["_i"].dataType
    most, lo, hi = sizes.agg(F.max("_n"), F.min("_i"), F.max("_i")).first()
    item = _narrowed(lo, hi, "bigint") if isinstance(kind, IntegralType) else kind
    tasks = lambda each: max(rows.sparkSession.sparkContext.defaultParallelism, -(-pairs // each))
    sized = rows.where("_f is not null").join(sizes, "_i").select(F.col("_n").cast(_narrowed(0, most or 0, "bigint")), F.col("_i").cast(item), "_f")
    lists = sized.repartition(tasks(8_000_000), "_f").groupBy("_f").agg(F.array_sort(F.collect_list(F.struct("_n", "_i"))).alias("_l"))
    lists = lists.where(F.size("_l") > 1).select(F.col("_l")["_i"].alias("_is"), F.col("_l")["_n"].alias("_ns")).select("*", F.posexplode("_is").alias("_k", "a")).where(F.col("_k") < F.size("_is") - 1)
    after = lambda c: F.slice(c, F.col("_k") + 2, F.size(c))
    lists = lists.select("a", F.get("_ns", "_k").alias("na"), after("_is").alias("b"), after("_ns").alias("nb"))
    met = lists.repartition(tasks(1_000_000), "a").select("a", "na", F.inline(F.arrays_zip("b", "nb"))).where("a <> b")
    met = met.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("shared"))
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return met.select(F.least("a", "b").cast(kind).alias("a"), F.greatest("a", "b").cast(kind).alias("b"), long("na"), long("nb"), "shared")


def _met_by_heads(rows: DataFrame, sizes: DataFrame, often: DataFrame, min_shared: int, min_jaccard: float) -> DataFrame:
    """(a, b, na, nb, shared) of all pairs that meet by a feature outside one's tail."""
    # the most frequent of an item, first among slices of it, so that no item's rows meet in one task
    slices = Window.partitionBy("_i", F.pmod(F.hash("_f"), F.lit(32))).orderBy(F.desc("_c"), F.desc("_f"))
    top = rows.join(often, "_f").withColumn("_k", F.row_number().over(slices)).where(F.col("_k") < min_shared)
    top = top.groupBy("_i").agg(F.sort_array(F.collect_list(F.struct("_c", "_f")), asc=False).alias("_t"))
    need = F.greatest(F.lit(1), F.least(F.lit(min_shared), F.ceil(F.lit(float(min_jaccard)) * F.col("_n") - 1e-9))).cast("int")
    tails = top.join(sizes, "_i").select("_i", F.slice(F.col("_t")["_f"], F.lit(1), need - 1).alias("_t"))
    tail = tails.select("_i", F.explode("_t").alias("_f"), F.lit(True).alias("_tail"))
    sides = rows.join(tail, ["_i", "_f"], "left").join(often.select("_f", F.lit(True).alias("_hot")), "_f", "left")
    # ways to meet: 0 head to head, 1 tail to head, 2 head to tail
    ways = lambda as_tail, as_head: F.explode(F.when(F.col("_tail"), F.array(F.lit(as_tail))).when(F.col("_hot"), F.array(F.lit(0), F.lit(as_head))).otherwise(F.array(F.lit(0))))
    a = sides.select(F.col("_i").alias("a"), "_f", ways(1, 2).alias("_m"))
    b = sides.select(F.col("_i").alias("b"), "_f", ways(2, 1).alias("_m"))
    met = a.join(b, ["_f", "_m"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("met"))
    per = sizes.join(tails, "_i", "left")
    met = met.join(per.toDF("a", "na", "ta"), "a").join(per.toDF("b", "nb", "tb"), "b")
    both = F.when(F.col("ta").isNotNull() & F.col("tb").isNotNull(), F.size(F.array_intersect("ta", "tb"))).otherwise(F.lit(0))
    return met.select("a", "b", "na", "nb", (F.col("met") + both).alias("shared"))


def upper_median(rows: DataFrame, col: str, most: int = 50_000):
    """The value at place n // 2 of the sorted non-null numbers, as a scalar (null if there are none).

    A bounded sketch brackets the place, one aggregate counts what lies below, on and between the two values, and the
    search goes on strictly between them until at most ``most`` rows are left. Each step reads the column, moves none
    of it, and narrows the bracket some thousandfold; any two values of it would give the same result."""
    inside, accuracy = rows.select(col).where(F.col(col).isNotNull()), 10_000
    n, skipped, target = None, 0, None
    while True:
        p = 0.5 if n is None else (target - skipped) / n
        around = [min(max(p + d / accuracy, 0.0), 1.0) for d in (-2, 2)]
        count, pair = inside.agg(F.count("*"), F.percentile_approx(col, around, accuracy)).first()
        if not count:
            return None
        n, target = count, target or count // 2 + 1
        lo, hi = (F.lit(v).cast(inside.schema[col].dataType) for v in pair)
        c, wanted = F.col(col), target - skipped
        parts = (c < lo, c == lo, (c > lo) & (c < hi), (c == hi) & (hi > lo), c > hi)
        held = inside.agg(*[F.count_if(x) for x in parts]).first()
        for k, here in enumerate(held):
            if wanted <= here:
                break
            wanted, skipped = wanted - here, skipped + here
        if k in (1, 3):
            return pair[k // 2]
        inside, n = inside.where(parts[k]), here
        if n <= most:
            return inside.agg(F.sort_array(F.collect_list(col)).alias("v")).select(F.element_at("v", F.lit(int(wanted)))).first()[0]


def hash_sample(rows: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """The ``n`` rows with the least SHA-256 of seed and id."""
    return rows.withColumn("rank_hash", F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256)).orderBy("rank_hash", id_col).limit(n)


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def bounded_queue(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows (1 to 2000) in order: a top-k, no global sort."""
    if not 1 <= limit <= 2000:
        raise ValueError("a queue holds 1 to 2000 rows")
    return rows.orderBy(*order).limit(limit)


def merge_split(owners: DataFrame, sources: DataFrame, targets: DataFrame, key: str, source_key: str, target_key: str) -> DataFrame:
    """(key, sources, targets, kind): merge for several sources and one target, split for the converse."""
    counts = [side.groupBy(F.col(k).alias(f"_{name}")).agg(F.count("*").alias(name)) for side, k, name in ((sources, source_key, "sources"), (targets, target_key, "targets"))]
    out = owners.select(key)
    for c, name in zip(counts, ("sources", "targets")):
        out = out.join(c, F.col(key) == F.col(f"_{name}"), "left")
    a, b = (F.coalesce(n, F.lit(0)).cast("bigint") for n in ("sources", "targets"))
    kind = F.when((a >= 2) & (b == 1), "merge").when((a == 1) & (b >= 2), "split").otherwise("other")
    return out.select(key, a.alias("sources"), b.alias("targets"), kind.alias("kind"))


def family_counts(families: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(family, parent, n): children of each parent by family."""
    out = None
    for name, (rows, key) in families.items():
        part = rows.groupBy(F.col(key).alias("parent")).agg(F.count("*").alias("n")).select(F.lit(name).alias("family"), "parent", "n")
        out = part if out is None else out.unionByName(part)
    return out


def system_delta(rows: DataFrame, metric: str, system: str, value: str, left: str, right: str) -> DataFrame:
    """(metric, delta): one system's value less the other's."""
    side = lambda name: F.max(F.when(F.col(system) == name, F.col(value)))
    return rows.groupBy(metric).agg((side(left) - side(right)).alias("delta"))


def membership(rows: DataFrame, keys: list[str], label: str, names: dict[str, str]) -> DataFrame:
    """0/1 columns telling which labels a key has."""
    return rows.groupBy(*keys).agg(*[F.max((F.col(label) == k).cast("int")).alias(v) for k, v in names.items()])


def patched(rows: DataFrame, patch: DataFrame, keys: list[str], value: str, new: str) -> DataFrame:
    """Rows with the values of keyed cells replaced; a key occurs once in ``patch``."""
    return rows.join(patch, keys, "left").withColumn(value, F.coalesce(new, value)).drop(new)


def first_overlap(cells: DataFrame, column: str, value: str) -> DataFrame:
    """(a, b, first): the least value that two columns share. Values are made distinct by column first, so the
    join has at most one row per value and pair of columns."""
    one = cells.select(F.col(column).alias("a"), F.col(value).alias("v")).distinct()
    return one.join(one.select(F.col("a").alias("b"), "v"), "v").where("a < b").groupBy("a", "b").agg(F.min("v").alias("first"))
