"""Review actions and snapshots against plain Python, with nulls, repeats, empty tables and clashing columns."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import actions, review

HEAD = "action int, actor string, mode string, note string"
DECISION = "action int, subject int, decision string, reason string"


def by_hand(requests, decisions, known, known_decisions, revisions, evidence):
    live = {s for s, _ in revisions} - {p for _, p in revisions}
    old, out = {}, {}
    for a, *head in known:
        old.setdefault(a, set()).add(tuple(head))
    for a in {r[0] for r in requests if r[0] is not None}:
        heads = {tuple(r[1:]) for r in requests if r[0] == a}
        asked, kept = (Counter(d[1:] for d in side if d[0] == a) for side in (decisions, known_decisions))
        rep = next(iter(heads))[3]
        if len(heads) > 1 or a in old and old[a] != {h[:3] for h in heads}:
            state = "action_collision"
        elif a in old:
            state = "replayed" if asked == kept else "decision_collision"
        elif any(s not in live or s is None for s, *_ in asked):
            state = "subject_not_current"
        elif rep is not None and any((s, rep) not in evidence for s, *_ in asked):
            state = "no_evidence"
        else:
            state = "recorded"
        out[a] = (state, sum(asked.values()))
    return out


def run(spark, requests, decisions, known, known_decisions, revisions, evidence):
    frames = [(requests, HEAD + ", representation int"), (decisions, DECISION), (known, HEAD), (known_decisions, DECISION), (revisions, "subject int, supersedes int"), (evidence, "subject int, representation int")]
    return actions.answered(*[spark.createDataFrame(list(rows), schema) for rows, schema in frames])


@pytest.mark.parametrize("seed", range(3))
def test_answers(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    revisions = [(s, s - 1 if s % 7 == 0 else None) for s in range(40)] + [(3, None), (None, 11)]
    live = [s for s in range(40) if (s + 1) % 7 and s != 11]
    requests, decisions, known, kept = [], [], [], []
    for a in range(80):
        head = (a, pick("x", "y", None), pick("one", "batch"), pick(None, "n"))
        rep = pick(None, 1, 2)
        rows = [(a, pick(*live) if rng.random() < 0.95 else pick(None, 6, 11, 99), pick("accept", None), pick("r", None)) for _ in range(rng.randrange(4))]
        rows += rows[: a % 2]
        requests += [(*head, rep)] * (1 + a % 3 // 2)
        decisions += rows
        if rng.random() < 0.5:
            known.append(head if rng.random() < 0.8 else (a, "z", *head[2:]))
            kept += rows if rng.random() < 0.6 else rows[1:] + [(a, 1, "accept", None)]
    requests += [(None, "x", "one", None, None), (0, "other", "one", None, None)]
    known += [(200, "x", "one", None)]
    decisions += [(None, 1, "accept", None), (300, 1, "accept", None)]
    evidence = {(s, r) for s in live for r in (1, 2) if rng.random() < 0.8}
    args = (requests, decisions, known, kept, revisions, evidence)
    answers = run(spark, *args)
    want = by_hand(*args)
    assert {r.action: (r.state, r.decisions) for r in answers.collect()} == want and {s for s, _ in want.values()} == set(actions.STATES)
    added = actions.appended(answers, spark.createDataFrame(decisions, DECISION)).collect()
    assert Counter(map(tuple, added)) == Counter(d for d in decisions if d[0] in want and want[d[0]][0] == "recorded")


def test_a_recorded_request_replays(spark):
    requests, decisions = [(1, "x", "one", None, None)], [(1, 5, "accept", None), (1, 5, "accept", None)]
    assert run(spark, requests, decisions, [], [], [(5, None)], []).first().state == "recorded"
    known = [r[:4] for r in requests]
    # evidence and revisions no longer matter: the answer to a known action is what was recorded
    assert run(spark, requests, decisions, known, decisions, [(5, None), (6, 5)], []).first().state == "replayed"
    assert run(spark, requests, decisions, known, decisions[:1], [(5, None)], []).first().state == "decision_collision"
    assert run(spark, requests, [], known, decisions, [(5, None)], []).first().state == "decision_collision"


def test_empty(spark):
    assert run(spark, [], [], [], [], [], []).count() == 0
    assert tuple(run(spark, [(1, None, None, None, 3)], [], [], [], [], []).first()) == (1, "recorded", 0)


def test_extra_columns_with_clashing_names(spark):
    more = lambda df: df.withColumns({c: F.lit("q") for c in ("state", "decisions", "_id", "_n", "_k", "_known", "_d")})
    frames = [([(1, "x", "one", None, 2)], HEAD + ", representation int"), ([(1, 5, "accept", None)], DECISION), ([], HEAD), ([], DECISION), ([(5, None)], "subject int, supersedes int"), ([(5, 2)], "subject int, representation int")]
    got = actions.answered(*[more(spark.createDataFrame(rows, schema)) for rows, schema in frames])
    assert [tuple(r) for r in got.collect()] == [(1, "recorded", 1)]


def test_drift(spark):
    rows = [(1, 1, "a", None), (1, 2, "a", None), (2, 1, "b", "x"), (2, 5, "b", "é"), (3, 5, "c", "y"), (4, 1, None, None), (4, 5, "d", "y"), (5, 1, "k", "z")]
    changes = spark.createDataFrame(rows, "id int, at int, u string, v string")
    seen, now = (actions.state_as_of(changes, "id", [F.col("at")], upto) for upto in (F.col("at") <= 3, None))
    got = {r.id: (r.sha256, r.stale) for r in actions.drifted(seen, now.where("id <> 5"), "id", review.snapshot_hash(F.struct("u", "v"))).collect()}
    sha = lambda u, v: hashlib.sha256(json.dumps({"u": u, "v": v}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert got == {1: (sha("a", None), False), 2: (sha("b", "é"), True), 4: (sha("d", "y"), True), 5: (None, True)}
