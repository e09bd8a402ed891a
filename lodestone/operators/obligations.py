"""Result obligations: does a query's result hold what a case requires of it?

Required value sets (patterns) are matched to distinct result rows: every pattern needs a row of its own that holds
its values, each as often as the pattern has it. Which row fits which pattern is an equi-join on (case, value, which
occurrence), never a comparison of all pairs. Taking the first row that fits can fail where a matching exists, so
each case is decided by augmenting paths.

Equal patterns and rows that fit the same patterns of a case are one node with a capacity, so what one task holds of
a case are its distinct patterns and the distinct sets of patterns that rows fit, however many rows the case has.

* Integers and numbers are equal by value, other values by type and text. Nulls equal only nulls of the same type.
* A pattern without values fits every row. A case without patterns is met and not listed.
* ``exact`` also asks for as many rows as patterns.
* Both sides of a join grow with the cases, so none goes through the driver: files are many times smaller than their
  rows in memory, and an estimate from their size would broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed_key(kind: Column, value: Column) -> Column:
    """A text that equal typed values share."""
    plain = F.regexp_replace(F.regexp_replace(value.try_cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    numeric = kind.isin("integer", "number") & plain.isNotNull()
    return F.when(numeric, F.concat(F.lit("n:"), F.when(plain == "-0", "0").otherwise(plain))).otherwise(F.concat(kind, F.when(value.isNull(), "~").otherwise(F.concat(F.lit("="), value))))


def _occurrences(rows: DataFrame, owner: list[str], values: str) -> DataFrame:
    """(owner, v, k): the k-th occurrence of each value of each row."""
    seen = rows.select(*owner, F.posexplode(F.array_sort(values)).alias("p", "v"), F.array_sort(values).alias("_all"))
    return seen.select(*owner, "v", (F.col("p") - F.array_position("_all", F.col("v")) + 1).alias("k"))


def feasible(patterns: dict[str, int], groups: dict[tuple[str, ...], int]) -> int:
    """How many patterns get rows of their own. ``patterns``: name -> copies; ``groups``: the names that a kind of
    row fits -> rows. Each augmenting path moves as much as it can."""
    given: dict[tuple[str, tuple[str, ...]], int] = {}
    free = dict(groups)

    def find(name: str, amount: int, seen: set) -> int:
        for g in sorted(groups):
            if name not in g or g in seen:
                continue
            seen.add(g)
            if free[g]:
                n = min(amount, free[g])
                free[g] -= n
                given[name, g] = given.get((name, g), 0) + n
                return n
            for other in sorted({p for p, h in given if h == g and given[p, h]} - {name}):
                n = find(other, min(amount, given[other, g]), seen)
                if n:
                    given[other, g] -= n
                    given[name, g] = given.get((name, g), 0) + n
                    return n
        return 0

    total = 0
    for name in sorted(patterns):
        left = patterns[name]
        while left and (n := find(name, left, set())):
            left -= n
            total += n
    return total


def row_sets(results: DataFrame, patterns: DataFrame, exact: bool = False) -> DataFrame:
    """(case, patterns, rows, matched, met) for each case of ``patterns``.

    ``results``: case, row, values; ``patterns``: case, pattern, values; values are arrays of ``typed_key`` texts."""
    by_set = patterns.select("case", F.array_sort("values").alias("values")).groupBy("case", "values").agg(F.count("*").alias("copies"))
    named = by_set.withColumn("name", F.sha2(F.to_json(F.struct("values")), 256)).withColumn("size", F.size("values"))
    want = _occurrences(named, ["case", "name", "size"], "values")
    have = _occurrences(results, ["case", "row"], "values")
    fits = want.hint("merge").join(have, ["case", "v", "k"]).groupBy("case", "row", "name", "size").agg(F.count("*").alias("n")).where("n = size").select("case", "row", "name")
    anything = named.where("size = 0").select("case", "name").hint("merge").join(results.select("case", "row"), "case").select("case", "row", "name")
    kinds = fits.unionByName(anything).groupBy("case", "row").agg(F.array_sort(F.collect_set("name")).alias("names"))
    groups = kinds.groupBy("case", "names").agg(F.count("*").alias("n"))
    nodes = named.select("case", F.array("name").alias("names"), F.col("copies").alias("n"), F.lit(True).alias("wanted")).unionByName(groups.withColumn("wanted", F.lit(False)))
    case_type = dict(patterns.dtypes)["case"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes come sorted by case; a case is decided when the next one begins."""
        out: list[tuple] = []
        case, want, rows = None, {}, {}

        def decided() -> None:
            if want:
                out.append((case, sum(want.values()), feasible(want, rows)))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            return pa.record_batch([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["case", "patterns", "matched"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("case").type
            for c, names, n, wanted in zip(*(batch.column(x).to_pylist() for x in ("case", "names", "n", "wanted"))):
                if c != case:
                    decided()
                    case, want, rows = c, {}, {}
                (want if wanted else rows)[names[0] if wanted else tuple(names)] = n
            yield batch_of()
            out.clear()
        if kind is not None:
            decided()
            yield batch_of()

    dealt = nodes.repartition("case").sortWithinPartitions("case")
    found = dealt.select("case", "names", "n", "wanted").mapInArrow(match, f"case {case_type}, patterns bigint, matched bigint")
    counts = results.groupBy("case").agg(F.count("*").alias("rows"))
    out = found.where("patterns > 0").join(counts.hint("merge"), "case", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    met = (F.col("matched") == F.col("patterns")) & (~F.lit(exact) | (F.col("rows") == F.col("patterns")))
    return out.select("case", "patterns", "rows", "matched", met.alias("met"))


def holds_scalar(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """(case, met): whether some row of the case's result holds the case's value (``wanted``: case, v)."""
    values = results.select("case", F.explode(F.array_distinct("values")).alias("v")).distinct().withColumn("met", F.lit(True))
    return wanted.join(values.hint("merge"), ["case", "v"], "left").select("case", F.coalesce("met", F.lit(False)).alias("met"))


def tables_covered(events: DataFrame, required: DataFrame) -> DataFrame:
    """(case, met): every required table is read by a successful query of the case whose result meets its obligation.

    ``events``: case, tables (of one query), met; ``required``: case, table."""
    read = events.where("met").select("case", F.explode("tables").alias("table")).distinct().withColumn("there", F.lit(True))
    return required.join(read.hint("merge"), ["case", "table"], "left").groupBy("case").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("met"))
