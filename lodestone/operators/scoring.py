"""Scores of extracted candidates against reference truths, capability gates by mode, statistics of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import ratio

# Importance of a truth and verdicts on a candidate.
IMPORTANCE = ("must", "material", "context")
VERDICTS = ("correct", "unsupported", "redundant", "overmerged", "distorted")


def candidate_problems(candidates: DataFrame, truths: DataFrame) -> DataFrame:
    """(candidate, problem) of candidates (candidate, verdict, truths array) that cannot be scored: a verdict that is
    none, a truth that is not there, or more or fewer truths than the verdict has."""
    named = candidates.select("candidate", F.explode("truths").alias("truth")).join(truths.select("truth"), "truth", "left_anti").select("candidate").distinct().withColumn("unknown", F.lit(True))
    n = F.coalesce(F.size("truths"), F.lit(0))
    verdict = F.col("verdict")
    problem = (
        F.when(~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)), "unknown_verdict")
        .when(F.col("unknown"), "unknown_truth")
        .when((verdict == "correct") & (n != 1), "correct_needs_one_truth")
        .when((verdict == "overmerged") & (n < 2), "overmerged_needs_two_truths")
        .when(verdict.isin("redundant", "distorted") & (n == 0), "needs_a_truth")
    )
    return candidates.join(named, "candidate", "left").select("candidate", problem.alias("problem")).where("problem is not null")


def candidate_metrics(truths: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: counts, recall of must and material truths, precision and the rates of each fault; a ratio without
    denominator is null. A truth is covered by a candidate that is correct for it."""
    covered = candidates.where("verdict = 'correct'").select(F.get("truths", F.lit(0)).alias("truth")).where("truth is not null").distinct().withColumn("covered", F.lit(True))
    t = truths.join(covered, "truth", "left").agg(
        F.count("*").alias("truths"),
        *(F.count_if(F.col("importance") == i).alias(i) for i in IMPORTANCE),
        *(F.count_if((F.col("importance") == i) & F.col("covered")).alias(f"{i}_covered") for i in IMPORTANCE),
    )
    c = candidates.agg(F.count("*").alias("candidates"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))
    share = lambda a, b, name: ratio(F.col(a), F.col(b)).alias(name)
    return t.crossJoin(c).select(  # one row each
        "truths", "candidates", share("must_covered", "must", "must_recall"), share("material_covered", "material", "material_recall"), share("correct", "candidates", "precision"),
        share("unsupported", "candidates", "unsupported_rate"), share("redundant", "candidates", "redundant_rate"), share("overmerged", "candidates", "overmerge_rate"), share("distorted", "candidates", "distorted_rate"),
    )


def verdict_scores(cases: DataFrame, abstain: str = "insufficient_evidence") -> DataFrame:
    """One row over (expected, given, needed array, cited array): accuracy, recall of evidence over the cases that need
    some, precision and recall of abstentions. Without abstentions these are 1; without cases accuracy is null."""
    need = F.coalesce(F.size("needed"), F.lit(0))
    hit = F.coalesce(F.size(F.array_intersect("needed", "cited")), F.lit(0))
    e, g = F.col("expected") == abstain, F.col("given") == abstain
    out = cases.agg(
        F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("given")).alias("right"), F.coalesce(F.sum(need), F.lit(0)).alias("need"), F.coalesce(F.sum(F.when(need > 0, hit)), F.lit(0)).alias("hit"),
        F.count_if(e).alias("e"), F.count_if(g).alias("g"), F.count_if(e & g).alias("both"),
    )
    share = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(empty)
    return out.select(
        "n", share("right", "n", F.lit(None)).alias("accuracy"), share("hit", "need", F.lit(1.0)).alias("evidence_recall"),
        share("both", "g", F.when(F.col("e") > 0, 0.0).otherwise(1.0)).alias("abstention_precision"), share("both", "e", F.lit(1.0)).alias("abstention_recall"),
    )


def capability_states(required: DataFrame, cases: DataFrame) -> DataFrame:
    """(capability, mode, state) by the cases that cover a capability.

    ``required``: capability, mode (deterministic or semantic_gold); ``cases``: covers array, check (passed, failed or
    null), scope_frozen, gold_frozen, adjudicated, evaluation (passed, failed or null), digest. A deterministic
    capability fails if any case fails and is verified if one passes. A semantic one goes from scope to gold to
    adjudication to evaluation, as far as its best case has come; failing there counts before passing, and a pass
    needs the SHA-256 of its result."""
    c = cases.select(F.explode("covers").alias("capability"), "*").drop("covers")
    yes = lambda x: F.coalesce(x, F.lit(False))
    frozen = yes(F.col("scope_frozen")) & yes(F.col("gold_frozen"))
    ready = frozen & yes(F.col("adjudicated"))
    any_ = lambda x, name: F.bool_or(yes(x)).alias(name)
    per = c.groupBy("capability").agg(
        any_(F.col("check") == "failed", "failed"), any_(F.col("check") == "passed", "passed"), any_(F.col("scope_frozen"), "scope"), any_(frozen, "gold"), any_(ready, "ready"),
        any_(ready & (F.col("evaluation") == "failed"), "bad"), any_(ready & (F.col("evaluation") == "passed") & F.col("digest").rlike("^[0-9a-f]{64}$"), "good"), F.lit(True).alias("there"),
    )
    deterministic = F.when(F.col("failed"), "failed").when(F.col("passed"), "verified").otherwise("pending")
    semantic = (
        F.when(~F.col("scope"), "gold_scope_pending").when(~F.col("gold"), "gold_pending").when(~F.col("ready"), "adjudication_pending").when(F.col("bad"), "failed").when(F.col("good"), "verified").otherwise("evaluation_pending")
    )
    state = F.when(F.col("there").isNull(), "missing").when(F.col("mode") == "deterministic", deterministic).otherwise(semantic)
    return required.join(per, "capability", "left").select("capability", "mode", state.alias("state"))


def cell_statistics(cells: DataFrame, merged: DataFrame, by: str = "file") -> DataFrame:
    """(file, sheets, rows, cells, non_empty, formulas, merged_ranges, kinds) in one pass over the cells
    (file, sheet, row, kind); ``merged``: file, one row for each merged range. Rows of a sheet are its greatest."""
    per = cells.groupBy(by, "sheet").agg(F.max("row").alias("rows"), F.count("*").alias("cells"), F.count_if(F.col("kind") != "blank").alias("non_empty"), F.count_if(F.col("kind") == "formula").alias("formulas"), F.collect_set("kind").alias("kinds"))
    files = per.groupBy(by).agg(
        F.count("*").alias("sheets"), F.sum("rows").cast("bigint").alias("rows"), F.sum("cells").alias("cells"), F.sum("non_empty").alias("non_empty"), F.sum("formulas").alias("formulas"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"),
    )
    ranges = merged.groupBy(by).agg(F.count("*").alias("merged_ranges"))
    return files.join(ranges, by, "left").withColumn("merged_ranges", F.coalesce("merged_ranges", F.lit(0)))


def row_units(sheets: DataFrame) -> DataFrame:
    """(unit_id, sheet, row, non_empty, signature, formula, merged) of each row of each sheet (ordinal, name, rows of
    cells with a value of type and text, merged_ranges). A range holds a row between its least and greatest number."""
    rows = sheets.select("ordinal", "name", "merged_ranges", F.posexplode("rows").alias("p", "cells"))
    filled = F.filter("cells", lambda c: c["value"].isNotNull())
    kinds = F.array_sort(F.transform(filled, lambda c: F.coalesce(c["value"]["type"], F.lit("unknown"))))
    row = F.col("p") + 1
    numbers = lambda a: F.transform(F.regexp_extract_all(a, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint"))
    merged = F.exists("merged_ranges", lambda a: F.coalesce((F.array_min(numbers(a)) <= row) & (row <= F.array_max(numbers(a))), F.lit(False)))
    return rows.select(
        F.concat(F.col("ordinal").cast("string"), F.lit(":R"), row.cast("string")).alias("unit_id"), F.col("name").alias("sheet"), row.alias("row"), F.size(filled).alias("non_empty"),
        F.array_join(kinds, ";").alias("signature"), F.array_contains(kinds, "formula").alias("formula"), F.coalesce(merged, F.lit(False)).alias("merged"),
    )


def routing_table(seen: DataFrame, clusters: DataFrame, known: DataFrame) -> DataFrame:
    """(thread, signals, entities, origin): one row for each thread.

    ``seen``: thread, with items in the data; ``clusters``: cluster, name, entity, n; ``known``: thread, entity, full
    name. Threads in the data take the known entities and their full names as signals. A cluster whose name no such
    thread has takes its entities, most frequent first; of clusters of one name the first counts. What only known
    entities belong to follows, where neither has its name."""
    entities = known.groupBy("thread").agg(F.array_sort(F.collect_set("entity")).alias("entities"), F.array_sort(F.collect_set(F.struct("entity", "full"))).alias("pairs"))
    first = clusters.where("name <> ''").groupBy("name").agg(F.min("cluster").alias("cluster")).join(seen.select(F.col("thread").alias("name")).distinct(), "name", "left_anti")
    ranked = clusters.join(first, ["name", "cluster"]).groupBy(F.col("name").alias("thread")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "entity"))).alias("e"))
    listed = F.transform("e", lambda x: x["entity"])
    made = ranked.select("thread", listed.alias("signals"), listed.alias("entities"), F.lit("cluster").alias("origin"))
    names = seen.select("thread").distinct().withColumn("there", F.lit(True)).join(entities, "thread", "full_outer").join(first.select(F.col("name").alias("thread")), "thread", "left_anti")
    spoken = F.flatten(F.transform("pairs", lambda p: F.array_compact(F.array(p["entity"], F.nullif(p["full"], F.lit(""))))))
    empty = F.array().cast("array<string>")
    own = names.select("thread", F.coalesce(spoken, empty).alias("signals"), F.coalesce("entities", empty).alias("entities"), F.when(F.col("there"), "data").otherwise("known").alias("origin"))
    return own.unionByName(made)


def facet_columns(kind: Column, value: Column, cell: dict[str, Column], prefix: str) -> list[Column]:
    """All ten facets of a cell: kind, text, integer, number, boolean (0 or 1), datetime, formula, and its address,
    data type and number format (``cell``). Blank cells have no text; integers beyond 64 bits keep their text."""
    v = value.cast("string")
    truth = F.when(v.isin("true", "True", "1"), 1).otherwise(0)
    return [
        kind.alias(f"{prefix}_kind"),
        F.when(kind == "boolean", F.when(truth == 1, "true").otherwise("false")).when(kind != "blank", v).alias(f"{prefix}_text"),
        F.when(kind == "integer", v.try_cast("bigint")).alias(f"{prefix}_integer"),
        F.when(kind.isin("integer", "number"), v.try_cast("double")).alias(f"{prefix}_number"),
        F.when(kind == "boolean", truth).alias(f"{prefix}_boolean"),
        F.when(kind == "datetime", v).alias(f"{prefix}_datetime"),
        F.when(kind == "formula", v).alias(f"{prefix}_formula"),
        *(cell[c].cast("string").alias(f"{prefix}_{c}") for c in ("address", "data_type", "number_format")),
    ]
