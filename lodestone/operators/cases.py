"""Test cases generated from tables: supported, contradicted, absent, each with what proves it.

Cells are (table, row, column, value) with decimal values, or text for absences. For each (table, column) the sum of
its values is a claim that holds; the claim with another value is one that does not, and the other value must occur
nowhere in the table, so that no cell could be mistaken for its evidence. A sentinel text that no cell holds is a
claim of absence. Everything is decided by joins, none of the cells reach the driver, and reruns give the same cases.

* Values are moved by 1 if they are whole, else by 0.01, and again until they are absent: the first of STEPS moves
  that meets no cell, or what lies one move above the table's greatest value and the sum.
* Null cells are no cells. A column without values gives no case. Tables are told apart by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 8
_TYPE = "decimal(28,4)"


def _move(value: Column) -> Column:
    return F.when(value == F.floor(value), F.lit(1).cast(_TYPE)).otherwise(F.lit("0.01").cast(_TYPE))


def sums(cells: DataFrame) -> DataFrame:
    """(table, column, total): the claims that hold."""
    return cells.where("value is not null").groupBy("table", "column").agg(F.sum(F.col("value").cast("decimal(20,4)")).cast(_TYPE).alias("total"))


def counterfactual(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """``claims`` (table, column, total) with ``false_total``: another value that no cell of the table has."""
    values = cells.where("value is not null").select("table", F.col("value").cast(_TYPE).alias("v"))
    tried = claims.select("table", "column", "total", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("k"))
    tried = tried.withColumn("v", (F.col("total") + _move(F.col("total")) * F.col("k")).cast(_TYPE))
    # each value of a table once: a table that holds a third of the cells meets its few claims by value
    free = tried.join(values.distinct(), ["table", "v"], "left_anti")
    first = free.groupBy("table", "column").agg(F.min_by("v", "k").alias("found"))
    most = values.groupBy("table").agg(F.max("v").alias("most"))
    beyond = F.greatest("most", "total")
    out = claims.join(most, "table").join(first, ["table", "column"], "left")
    return out.select(*claims.columns, F.coalesce("found", (beyond + _move(beyond)).cast(_TYPE)).alias("false_total"))


def sentinels(tables: DataFrame, texts: DataFrame, seed: str) -> DataFrame:
    """(table, sentinel): a text for each table that none of its cells holds. ``texts``: table, text."""
    tried = tables.select("table").distinct().select("table", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("k"))
    named = tried.withColumn("text", F.concat(F.lit("absent-"), F.substring(F.sha2(F.concat_ws("\n", F.lit(seed), F.col("table").cast("string"), F.col("k").cast("string")), 256), 1, 16)))
    return named.join(texts.select("table", "text").distinct(), ["table", "text"], "left_anti").groupBy("table").agg(F.min_by("text", "k").alias("sentinel"))


def build(cells: DataFrame, texts: DataFrame, seed: str) -> DataFrame:
    """(case_id, table, column, relation, value, obligation, required_tables) of every case.

    ``obligation`` says what a result has to hold: the scalar of a sum, or a zero for every required table."""
    claims = counterfactual(sums(cells), cells)
    text = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    relation = lambda name, value, proof: F.struct(F.lit(name).alias("relation"), text(value).alias("value"), text(proof).alias("proof"))
    both = claims.select("table", "column", F.explode(F.array(relation("supported", "total", "total"), relation("contradicted", "false_total", "total"))).alias("r"))
    stated = both.select("table", "column", "r.relation", "r.value", F.lit("contains_scalar").alias("obligation"), F.col("r.proof").alias("proof"))
    absent = sentinels(cells, texts, seed).select("table", F.lit(None).cast("string").alias("column"), F.lit("absent").alias("relation"), F.col("sentinel").alias("value"),
                                                  F.lit("zero_result_for_each_required_table").alias("obligation"), F.lit("0").alias("proof"))
    out = stated.unionByName(absent)
    case_id = F.substring(F.sha2(F.concat_ws("\n", F.lit(seed), F.col("table").cast("string"), F.coalesce("column", F.lit("")), "relation"), 256), 1, 20)
    return out.select(case_id.alias("case_id"), "*", F.array(F.col("table").cast("string")).alias("required_tables"))
