"""Review actions: a request of one header and any number of decisions is recorded whole, replayed or refused whole.

Decisions are compared as multisets by counting, never gathered, so one batch may hold any share of all rows. Nulls
equal only nulls in headers and decisions; a decision without a subject is never current; a request that decides
nothing is recorded with no decisions; a request sent several times with the same header counts once, with its
decisions as given; two headers of one action refuse it. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a request is answered with; only ``recorded`` appends rows.
STATES = ("replayed", "action_collision", "decision_collision", "subject_not_current", "no_evidence", "recorded")
HEADER, DECISION = ("actor", "mode", "note"), ("subject", "decision", "reason")


def current_ids(revisions: DataFrame, id_col: str, supersedes: str) -> DataFrame:
    """(_id) of revisions that exist and that none supersedes."""
    gone = revisions.select(F.col(supersedes).alias("_id")).where("_id is not null").distinct()
    return revisions.select(F.col(id_col).alias("_id")).distinct().join(gone, "_id", "left_anti")


def _any(flags: DataFrame, name: str) -> DataFrame:
    return flags.select("action").distinct().withColumn(name, F.lit(True))


def _differing(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Actions whose rows in ``left`` and ``right`` are not the same multiset."""
    sides = left.select("action", *by, F.lit(1).alias("_n")).union(right.select("action", *by, F.lit(-1).alias("_n")))
    return sides.groupBy("action", *by).agg(F.sum("_n").alias("_n")).where("_n <> 0")


def answered(requests: DataFrame, decisions: DataFrame, known: DataFrame, known_decisions: DataFrame, revisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(action, state, decisions): the answer to each request.

    requests, known: action, actor, mode, note (requests also representation, null for single decisions);
    decisions, known_decisions: action, subject, decision, reason; revisions: subject, supersedes;
    evidence: subject, representation, of current and active links only."""
    heads = requests.select("action", *HEADER, "representation").where("action is not null").distinct()
    several = heads.groupBy("action").agg(F.count("*").alias("_k"))
    old = known.select("action", *HEADER).distinct()
    changed = heads.select("action", *HEADER).join(old.select("action").distinct(), "action", "left_semi")
    head_differs = _any(_differing(changed.distinct(), old.join(heads.select("action"), "action", "left_semi"), HEADER), "_head")
    # decisions are counted by what they say before they meet anything, so an action of any size shrinks first
    decides_differ = _any(_differing(decisions, known_decisions, DECISION), "_decides")
    pairs = decisions.select("action", "subject").distinct()
    gone = pairs.join(current_ids(revisions, "subject", "supersedes"), F.col("subject") == F.col("_id"), "left_anti")
    batch = pairs.join(heads.where("representation is not null").select("action", "representation"), "action")
    bare = batch.join(evidence.select("subject", "representation").distinct(), ["subject", "representation"], "left_anti")
    out = several.join(old.select("action", F.lit(True).alias("_known")).distinct(), "action", "left")
    for part in (head_differs, decides_differ, _any(gone, "_gone"), _any(bare, "_bare"), decisions.groupBy("action").agg(F.count("*").alias("_d"))):
        out = out.join(part, "action", "left")
    state = (
        F.when((F.col("_k") > 1) | (F.col("_known") & F.col("_head")), STATES[1]).when(F.col("_known") & F.col("_decides"), STATES[2]).when(F.col("_known"), STATES[0])
        .when(F.col("_gone"), STATES[3]).when(F.col("_bare"), STATES[4]).otherwise(STATES[5])
    )
    return out.select("action", state.alias("state"), F.coalesce("_d", F.lit(0)).cast("bigint").alias("decisions"))


def appended(answers: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decision rows that the recorded requests add."""
    return decisions.join(answers.where(F.col("state") == STATES[5]).select("action"), "action", "left_semi")


def state_as_of(changes: DataFrame, key: str, order: list[Column], upto: Column | None = None) -> DataFrame:
    """Each key's last change in a total order, of those ``upto`` holds for: an aggregate, so it combines map-side."""
    rows = changes.where(upto) if upto is not None else changes
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)])).alias("_r")).select(key, "_r.*")


def drifted(seen: DataFrame, now: DataFrame, key: str, snapshot: Column) -> DataFrame:
    """(key, sha256, stale) of each row seen: its present hash (null if it is gone) and whether that is another than was seen."""
    before = seen.select(key, snapshot.alias("_seen"))
    after = now.select(F.col(key).alias("_key"), snapshot.alias("sha256"))
    return before.join(after, F.col(key) == F.col("_key"), "left").select(key, "sha256", (~F.col("_seen").eqNullSafe(F.col("sha256"))).alias("stale"))
