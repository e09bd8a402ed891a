"""Difference of two snapshots of a table, rows whose key changed included.

Rows of equal key pair first. Among the rest, rows of equal content pair by rank: the i-th smallest earlier key
with the i-th largest later key. Ranks come from a skew-proof ranking: all rows left over are range-sorted by
(content, side, directed key), each partition counts its runs of equal (content, side), the counts are
prefix-summed over the partitions, and a row's rank is its place in its run plus the sum before it. A content
that holds a third of all rows so lies in a third of the partitions, and the join on (content, rank) deals its
rows evenly. Only digests, keys and ranks move; nothing is broadcast on purpose, collected or sent through one task.

* Content is compared by 128-bit digests of each column, null apart from every text. Keys are integers.
* A null key equals null keys only, and is the smallest of all.
* Keys that repeat on a side: their rows pair by the same ranking, equal contents first (copy by copy), then the
  rest of the key in the order of their digests. Rows equal in everything are interchangeable.
* Empty and very long texts are ordinary values. An empty side makes all rows of the other inserts or deletes.
  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stage

COLUMNS = ("text", "lang", "source")


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The later snapshot of the contract: crc32 of the decimal doc_id modulo 10 says what becomes of a row.
    A row without an id stays as it is."""
    key, kind = F.col("doc_id").cast("bigint"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    turned = F.lit(-1).cast("bigint") - key
    keys = F.when(kind == 0, F.array().cast("array<bigint>")).when(kind.isin(3, 4), F.array(turned)).when(kind == 5, F.array(key, turned)).otherwise(F.array(key))
    return docs.select(
        F.explode(keys).alias("doc_id"),
        F.when(kind == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(kind == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(kind == 2, F.col("lang")).when(kind == 4, F.lit(None)).otherwise(F.col("source")).alias("source"),
    )


def _narrow(rows: DataFrame, key: str, columns: tuple[str, ...], side: int) -> DataFrame:
    """(side, key, one digest a column, content digest, row digest): all that moves of a row."""
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("string").cast("binary")))
    whole = F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    sha = F.unhex(F.sha2(whole.cast("binary"), 256)) if side else F.lit(None).cast("binary")
    out = rows.select(F.lit(side).alias("side"), F.col(key).cast("bigint").alias("key"), *(digest(c).alias(f"d{i}") for i, c in enumerate(columns)), sha.alias("sha"))
    marked = (F.coalesce(F.concat(F.lit(b"="), F.col(f"d{i}")), F.lit(b"-")) for i in range(len(columns)))
    return out.withColumn("content", F.unhex(F.md5(F.concat(*marked))))


def _same(names: list[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"{prefix}{n}")) for n in names))


def ranked(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with their exact ``rank`` (from 1) by ``order`` within ``group``; rows equal in both are ordered by
    ``row``, a column that tells all rows apart. Every partition holds about as many rows, whatever the groups."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*group, *order, "row"]
    # a row's place: the partition in the upper bits, from the 33rd, its index in the sorted partition below
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = stage(dealt.withColumn("part", F.shiftright("at", 33)), f"{label}-sorted")
    runs = dealt.groupBy("part", *group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a partition
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    runs = runs.select(*(F.col(c).alias(f"r_{c}") for c in ["part", *group]), (F.col("first") - F.col("before")).alias("base"))
    met = dealt.join(runs, _same(["part", *group], "r_"))
    return met.select(*rows.columns, (F.col("at") - F.col("base") + 1).alias("rank"))


def _met(rows: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join of the two sides on ``on``: columns of both, the earlier ones with the prefix ``e_``."""
    earlier = rows.where("side = 0").select(*(F.col(c).alias(f"e_{c}") for c in rows.columns))
    return earlier.join(rows.where("side = 1"), _same(on, "e_"), "full_outer")


def _alone(met: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``met`` that have no partner, as they were."""
    one = met.where("side is null or e_side is null")
    return one.select(*(F.coalesce(F.col(c), F.col(f"e_{c}")).alias(c) for c in columns))


def _paired(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    return stage(_met(ranked(rows, ["side", *group], order, label), [*group, "rank"]).drop("rank", "e_rank"), f"{label}-met")


def snapshot_diff(earlier: DataFrame, later: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(key, old_key, op, changed, row_sha256) for each pair and each row without one."""
    with scratch():
        rows = _narrow(earlier, key, columns, 0).unionByName(_narrow(later, key, columns, 1))
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "diff-rows")
        names = rows.columns
        # the digest orders rows of a repeated key; for pairs by content the later side's keys are taken downwards
        rest, pairs = rows, []
        if rows.groupBy("side", "key").count().where("count > 1").isEmpty():
            met = stage(_met(rows, ["key"]), "diff-keys")
            rest, pairs = _alone(met, names), [met]
        else:
            for step, group in (("copies", ["key", "content"]), ("keys", ["key"])):
                met = _paired(rest, group, ["content"], f"diff-{step}")
                rest, pairs = _alone(met, names), [*pairs, met]
        pairs = [p.where("side is not null and e_side is not null") for p in pairs]
        down = F.col("side") == 1
        rest = rest.withColumn("last", F.col("key").isNull() == down).withColumn("directed", F.when(down, F.bitwise_not("key")).otherwise(F.col("key")))
        met = _paired(rest, ["content"], ["last", "directed"], "diff-content").drop("last", "directed", "e_last", "e_directed")
        kind = F.when(F.col("side").isNull(), "delete").when(F.col("e_side").isNull(), "insert").otherwise("rekey")
        by_key = reduce(DataFrame.unionByName, pairs).withColumn("op", F.when(F.col("content") == F.col("e_content"), "same").otherwise("update"))
        differing = F.array(*(F.when(~F.col(f"d{i}").eqNullSafe(F.col(f"e_d{i}")), F.lit(c)) for i, c in enumerate(columns)))
        out = by_key.unionByName(met.withColumn("op", kind)).select(
            F.when(F.col("side").isNull(), F.col("e_key")).otherwise(F.col("key")).alias("key"),
            F.col("e_key").alias("old_key"),
            "op",
            F.when(F.col("op") == "update", F.array_join(differing, ",")).otherwise("").alias("changed"),
            F.lower(F.hex("sha")).alias("row_sha256"),
        )
        return stage(out, "diff", keep=True)
