"""Review and claim control: life cycle, review state, batches, copy-forward, assessment chains, routing, gates.

Tables are append-only; each function derives or guards rows and leaves writing to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (action, states it may start from, state it leads to).
LIFECYCLE = (("restrict", ("active",), "restricted"), ("unrestrict", ("restricted",), "active"), ("retract", ("active", "restricted"), "retracted"))


def next_lifecycle(state: Column, action: Column) -> Column:
    """The state an action leads to, null where the action is not allowed."""
    out = F.lit(None).cast("string")
    for name, sources, target in LIFECYCLE:
        out = F.when((action == name) & state.isin(*sources), target).otherwise(out)
    return out


def review_state(origin: Column, current: Column, lifecycle: Column, decision: Column) -> Column:
    """Struct (machine_only, human_reviewed, unreviewed_human, strict_ready)."""
    none = decision.isNull()
    return F.struct(
        (origin.isin("machine", "rule") & none).alias("machine_only"), (~none).alias("human_reviewed"),
        ((origin == "human") & none).alias("unreviewed_human"),
        (current & (lifecycle == "active") & F.coalesce(decision == "accepted", F.lit(False))).alias("strict_ready"),
    )


def fingerprint(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """SHA-256 of the canonical JSON list of each group's sorted ids: a batch's identity, whatever its order."""
    ids = F.to_json(F.array_sort(F.collect_set(F.col(id_col).cast("string"))))
    return rows.groupBy(*keys).agg(F.sha2(ids, 256).alias("fingerprint"), F.countDistinct(id_col).alias("members"))


def snapshot_hash(row: Column) -> Column:
    """SHA-256 of a struct's JSON, nulls included: equal exactly while nothing of the row has changed."""
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def stale(expected: DataFrame, now: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """Rows of ``expected`` whose hash is not the present one any more (or whose row is gone)."""
    n = now.select(F.col(id_col).alias("_id"), F.col(hash_col).alias("_h"))
    return expected.join(n, F.col(id_col) == F.col("_id"), "left").where(~F.coalesce(F.col(hash_col) == F.col("_h"), F.lit(False))).drop("_id", "_h")


def batch_decisions(batch: DataFrame, overrides: DataFrame, id_col: str, default: Column, decision: str = "decision") -> DataFrame:
    """Every member with its override's decision, else the default."""
    o = overrides.select(F.col(id_col).alias("_id"), F.col(decision).alias("_d"))
    return batch.join(o, F.col(id_col) == F.col("_id"), "left").withColumn(decision, F.coalesce("_d", default)).drop("_id", "_d")


def strays(batch: DataFrame, overrides: DataFrame, id_col: str) -> DataFrame:
    """Overrides of rows that are not in the batch: it must be empty before a batch is applied."""
    return overrides.join(batch.select(F.col(id_col).alias("_id")), F.col(id_col) == F.col("_id"), "left_anti")


def copy_forward(links: DataFrame, selected: DataFrame, owner: str, link: str, new_owner: str) -> DataFrame:
    """The selected links under their owner's next revision. ``selected`` has (owner, link, new_owner)."""
    s = selected.select(F.col(owner).alias("_o"), F.col(link).alias("_l"), F.col(new_owner).alias("_n"))
    kept = links.join(s, (F.col(owner) == F.col("_o")) & (F.col(link) == F.col("_l")))
    return kept.withColumn(owner, F.col("_n")).drop("_o", "_l", "_n")


def appendable(actions: DataFrame, subjects: DataFrame, evidence: DataFrame, known: DataFrame, id_col: str, subject: str) -> DataFrame:
    """New actions on current subjects that have active evidence: replays of known ids are left out."""
    on = lambda df: df.select(F.col(subject).alias("_s")).distinct()
    out = actions.join(known.select(F.col(id_col).alias("_i")), F.col(id_col) == F.col("_i"), "left_anti")
    for side in (subjects, evidence):
        out = out.join(on(side), F.col(subject) == F.col("_s"), "left_semi")
    return out


def referenced(owners: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys that any owner refers to."""
    out = owners[0].select(key)
    for o in owners[1:]:
        out = out.union(o.select(key))
    return out.where(F.col(key).isNotNull()).distinct()


def scrubbed(rows: DataFrame, purged: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """All rows, with null payload where the key is purged."""
    p = purged.select(F.col(key).alias("_p")).distinct().withColumn("_gone", F.lit(True))
    joined = rows.join(p, F.col(key) == F.col("_p"), "left")
    return joined.withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in payload}).drop("_p", "_gone")


def eligible(requests: DataFrame, processors: DataFrame) -> DataFrame:
    """(request_id, processor, position) pairs that may run. Requests: request_id, capability, media, kinds (array),
    bytes, restricted, egress_allowed. Processors (a registry, so broadcast): processor, position, p_capability,
    p_media (array), p_kinds (array), p_bytes (null: any), p_egress."""
    ok = (
        (F.col("capability") == F.col("p_capability")) & F.array_contains("p_media", F.col("media")) & (F.size(F.array_except("kinds", "p_kinds")) == 0)
        & (F.col("p_bytes").isNull() | (F.col("bytes") <= F.col("p_bytes"))) & (~F.col("p_egress") | (~F.col("restricted") & F.col("egress_allowed")))
    )
    return requests.join(F.broadcast(processors), ok).select("request_id", "processor", "position")


def routed(pairs: DataFrame) -> DataFrame:
    """The processor registered first for each request."""
    return pairs.groupBy("request_id").agg(F.min_by("processor", "position").alias("processor"))


def coverage_gate(required: DataFrame, cases: DataFrame, capability: str, covers: str, status: str) -> DataFrame:
    """Each required capability: verified, failed, pending or missing, by the best of the cases that cover it."""
    c = cases.select(F.explode(covers).alias("_c"), F.col(status).alias("_s")).groupBy("_c").agg(
        F.bool_or(F.col("_s") == "failed").alias("_f"), F.bool_or(F.col("_s") == "verified").alias("_v"))
    state = F.when(F.col("_c").isNull(), "missing").when(F.col("_f"), "failed").when(F.col("_v"), "verified").otherwise("pending")
    return required.join(c, F.col(capability) == F.col("_c"), "left").select(capability, state.alias("state"))


def latest_assessment(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Each chain's newest row with its length."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy(*[o.desc() for o in order])), "chain_length": F.count("*").over(w)})
    return ranked.where("_r = 1").drop("_r")


def uncontained(inputs: DataFrame, scopes: DataFrame, key: list[str], inside: Column) -> DataFrame:
    """Derivation inputs that no scope of their key contains; a derivation is admitted if there are none."""
    s = scopes.withColumnsRenamed({k: f"_{k}" for k in key})
    same = [F.col(k) == F.col(f"_{k}") for k in key]
    for extra in same:
        inside = extra & inside
    return inputs.join(s, inside, "left_anti")
