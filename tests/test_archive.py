"""Connectors, the kept index, review units, obligations, promotion, commits and purges against plain Python."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions.units import review_units, units
from lodestone.operators import obligations, promotion, purge
from lodestone.operators.retrieval import TextIndex
from lodestone.sources import connector
from lodestone.sources.versions import CommitError, VersionedStore, orphans, repeated
from lodestone.streaming import inbox

# --- connectors


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, "k bigint, who bigint, ts timestamp_ntz, kind string").coalesce(1).write.parquet(f"{folder}/{name}")


def feed(spark, folder, **options):
    named = {"path": str(folder), "id": "k", "locator": "who", "observed_at": "ts", "outcome": "kind", "failed": "error", "rows_per_step": "3", "rows_per_task": "2"}
    return spark.readStream.format(connector.register(spark)).options(**(named | options)).load()


def at(n):
    return datetime(2024, 1, 1, 0, 0, n)


def test_runs_go_on_where_the_last_one_ended(spark, tmp_path):
    source, box, state = tmp_path / "source", str(tmp_path / "inbox"), str(tmp_path / "state")
    put(spark, source, "a", [(k, k % 2, at(k), "ok") for k in range(7)])
    run = lambda **o: inbox.run_connector(spark, connector.RecordFeed.descriptor, feed(spark, source), box, state, **o)
    first = run()
    assert (first.emitted, first.accepted, first.replayed) == (7, 7, 0) and isinstance(first.next_checkpoint, bytes)
    assert run().emitted == 0
    put(spark, source, "b", [(k, k % 2, at(k), "error") for k in (9, 8)] + [(3, 1, at(3), "ok")])  # one row came before
    second = run()
    assert (second.emitted, second.accepted, second.replayed) == (3, 2, 1) and second.next_checkpoint != first.next_checkpoint
    rows = {r["id"]: (r["locator"], r["outcome"], json.loads(r["payload"])["kind"]) for r in inbox.received(spark, box).collect()}
    assert rows == {str(k): (str(k % 2), "failed" if k > 7 else "success", "error" if k > 7 else "ok") for k in (0, 1, 2, 3, 4, 5, 6, 8, 9)}
    again = run(restart=True)
    assert (again.emitted, again.accepted, again.replayed) == (10, 0, 10) and inbox.received(spark, box).count() == 9


def test_a_known_id_with_another_payload_stops_the_run(spark, tmp_path):
    source, box, state = tmp_path / "source", str(tmp_path / "inbox"), str(tmp_path / "state")
    put(spark, source, "a", [(1, 1, at(1), "ok")])
    inbox.run_connector(spark, connector.RecordFeed.descriptor, feed(spark, source), box, state)
    put(spark, source, "b", [(2, 1, at(2), "ok"), (1, 1, at(1), "changed")])
    with pytest.raises(Exception, match="another payload"):
        inbox.run_connector(spark, connector.RecordFeed.descriptor, feed(spark, source), box, state)
    assert [r["id"] for r in inbox.received(spark, box).collect()] == ["1"]


def test_reports_are_held_against_capabilities():
    with pytest.raises(connector.ConnectorError):
        connector.Descriptor("Upper", "1", frozenset({"pull"}))
    with pytest.raises(connector.ConnectorError):
        connector.Descriptor("x", "1", frozenset({"teleport"}))
    pull = connector.Descriptor("x", "1", frozenset({"pull"}))
    ok = connector.RunReport("unknown", 3, 2, 1, None)
    assert ok.checked(pull) is ok
    for bad in (("incremental", 3, 2, 1, None), ("complete_inventory", 3, 2, 1, None), ("unknown", 3, 2, 0, None), ("unknown", 3, 2, 1, b"x"), ("all", 0, 0, 0, None)):
        with pytest.raises(connector.ConnectorError):
            connector.RunReport(*bad).checked(pull)


def test_latest_success_keeps_one_row_a_locator(spark, tmp_path):
    put(spark, tmp_path / "source", "a", [(1, 1, at(1), "ok"), (2, 1, at(9), "error"), (10, 2, at(5), "ok"), (9, 2, at(5), "ok"), (3, 1, None, "ok"), (4, None, at(4), None)])
    target, state = str(tmp_path / "latest"), str(tmp_path / "state")
    assert inbox.run_latest(feed(spark, tmp_path / "source"), target, state) == 6
    get = lambda: sorted(((r["locator"], r["id"]) for r in inbox.latest(spark, target).collect()), key=str)
    assert get() == [("1", "1"), ("2", "10"), (None, "4")]
    put(spark, tmp_path / "source", "b", [(5, 1, at(2), "ok"), (6, 2, at(1), "ok"), (7, 1, at(59), "error")])
    assert inbox.run_latest(feed(spark, tmp_path / "source"), target, state) == 3
    assert get() == [("1", "5"), ("2", "10"), (None, "4")]


# --- the kept index


def test_index_follows_its_documents(spark, tmp_path):
    index = TextIndex(spark, "postings_of_a_test", str(tmp_path / "index"), ("kind",))
    rows = lambda *r: spark.createDataFrame(list(r), "id bigint, text string, kind string")
    assert index.update(rows((1, "To be, or not to be", "a"), (2, "not to be so", "b"), (3, None, "b"), (4, "", "a")), "id", "text") == {"written": 4, "gone": 0}
    found = lambda *w: sorted((r["doc"], list(r["starts"])) for r in index.phrase(list(w)).collect())
    assert found("to", "be") == [(1, [0, 4]), (2, [1])] and found("be", "to") == [] and found("to", "be", "or", "not", "to") == [(1, [0])] and found("NOT") == [(1, [3]), (2, [0])]
    assert index.update(rows((1, "To be, or not to be", "a"), (2, "nothing", "b"), (4, "", "c"), (5, "be be", "a")), "id", "text") == {"written": 3, "gone": 1}
    assert found("be") == [(1, [1, 5]), (5, [0, 1])] and found("be", "be") == [(5, [0])]
    assert sorted(map(tuple, index.prefix("NOT").collect())) == [(1, "not"), (2, "nothing")]
    both = index.holding(["be"])
    assert [r["doc"] for r in index.retrieve(both, F.col("kind") == "a").collect()] == [1, 5]
    assert [r["doc"] for r in index.retrieve(both, related=spark.createDataFrame([(5, "tag"), (2, "tag")], "doc bigint, tag string")).collect()] == [5]
    assert index.update(rows((1, "To be, or not to be", "a"), (2, "nothing", "b"), (4, "", "c"), (5, "be be", "a")), "id", "text") == {"written": 0, "gone": 0}
    plan = index.phrase(["to", "be"])._jdf.queryExecution().toString()
    assert "SelectedBucketsCount: 2 out of 16" in plan or "SelectedBucketsCount: 1 out of 16" in plan
    # an update that stopped half way has postings but no documents: no search sees them
    spark.sql("INSERT INTO postings_of_a_test PARTITION (segment = 9) SELECT 'be', 77, array(0)")
    assert found("be") == [(1, [1, 5]), (5, [0, 1])]
    again = TextIndex(spark, "postings_of_a_test_again", str(tmp_path / "index"), ("kind",))
    assert [r["doc"] for r in again.holding(["nothing"]).collect()] == [2]


# --- review units


def brute_units(text, most, preferred):
    """Starts by the rules, one round of cuts after another."""
    lines, pos = [], 0
    for raw in text.splitlines(keepends=True):
        lines.append((pos, raw))
        pos += len(raw)
    starts = {0} if text else set()
    for (_, before), (at_, raw) in zip(lines, lines[1:]):
        blank = lambda x: not x.replace("\f", "").strip()
        if not blank(raw) and ("\f" in before or blank(before)):
            starts.add(at_)
    while True:
        order = sorted(starts | {len(text)})
        new = set()
        for a, b in zip(order, order[1:]):
            if b - a > most:
                after = [p for p, _ in lines if p >= a + preferred]
                if after and after[0] < b:
                    new.add(after[0])
        if not new - starts:
            return [text[a:b] for a, b in zip(order, order[1:])]
        starts |= new


def test_units_are_the_text(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", "\f", "a", "a\n\n\nb", "x\f\fy\n\nz", "long " * 50, "a\r\n\r\nb\x0bc d\x85e"]
    for _ in range(300):
        texts.append("".join(rng.choice(["word ", "é", "\n", "\n\n", "\f", "\r\n", " \n", "longer line of words\n", "\n\f"]) for _ in range(rng.randrange(60))))
    for t in texts:
        got = list(units(t, 60, 40))
        assert [u["text"] for u in got] == (brute_units(t, 60, 40) if t else [])
        for u in got:
            assert t[u["char_start"] : u["char_end"]] == u["text"] and u["preview"] == " ".join(u["text"].split())[:280]
            starts = [0]
            for raw in t.splitlines(keepends=True):
                starts.append(starts[-1] + len(raw))
            page = lambda p: 1 + t[: max(x for x in starts if x <= p)].count("\f") if "\f" in t else None
            assert (u["page_start"], u["page_end"]) == (page(u["char_start"]), page(u["char_end"] - 1))
    rows = review_units(spark.createDataFrame(list(enumerate(texts)), "n bigint, t string").repartition(3), "n", "t", 60, 40).collect()
    for n, t in enumerate(texts):
        mine = sorted((r for r in rows if r["n"] == n), key=lambda r: r["char_start"])
        assert "".join(r["text"] for r in mine) == (t or "") and [r["unit_id"] for r in mine] == [f"U{i + 1:04d}" for i in range(len(mine))]


def test_units_know_their_kind_and_pages():
    got = list(units("one\n\ntwo\n\fthree\nfour\n" + "five six\n" * 12, 60, 40))
    assert [(u["kind"], u["page_start"]) for u in got][:4] == [("source", 1), ("block", 1), ("page", 2), ("continuation", 2)]
    assert [u["kind"] for u in units("a\fb\n\nc")] == ["source", "page", "block"] and [u["page_start"] for u in units("no pages\n\nhere")] == [None, None]


# --- obligations


def test_matching_beats_taking_the_first_row(spark):
    results = [("g", 1, ["a", "b"]), ("g", 2, ["a"]), ("s", 1, ["a"]), ("m", 1, ["x", "x"]), ("m", 2, ["x"]), ("e", 1, ["q"]), ("e", 2, ["q"]), ("z", 1, ["p"])]
    patterns = [("g", 1, ["a"]), ("g", 2, ["b"]), ("s", 1, ["a"]), ("s", 2, ["a"]), ("m", 1, ["x"]), ("m", 2, ["x", "x"]), ("e", 1, ["q"]), ("n", 1, ["q"]), ("z", 1, [])]
    frames = spark.createDataFrame(results, "case string, row int, values array<string>"), spark.createDataFrame(patterns, "case string, pattern int, values array<string>")
    got = {r["case"]: (r["patterns"], r["rows"], r["matched"], r["met"]) for r in obligations.row_sets(*frames).collect()}
    assert got == {"g": (2, 2, 2, True), "s": (2, 1, 1, False), "m": (2, 2, 2, True), "e": (1, 2, 1, True), "n": (1, 0, 0, False), "z": (1, 1, 1, True)}
    exact = {r["case"]: r["met"] for r in obligations.row_sets(*frames, exact=True).collect()}
    assert exact == {"g": True, "s": False, "m": True, "e": False, "n": False, "z": True}


def test_matching_equals_brute_force():
    from itertools import permutations

    rng = random.Random(3)
    for _ in range(400):
        names = "abcd"[: rng.randrange(1, 5)]
        rows = [tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1)))) for _ in range(rng.randrange(6))]
        copies = {n: rng.randrange(1, 3) for n in names}
        wanted = [n for n in names for _ in range(copies[n])]
        slots = rows + [()] * len(wanted)
        best = max(sum(n in r for n, r in zip(wanted, p)) for p in set(permutations(slots, len(wanted)))) if len(slots) <= 7 else None
        groups = {}
        for r in rows:
            groups[r] = groups.get(r, 0) + 1
        got = obligations.feasible(copies, groups)
        assert best is None or got == best


def test_typed_values_and_tables(spark):
    values = [("integer", "5"), ("number", "5.0"), ("number", "5.10"), ("text", "5"), ("integer", "-0"), ("integer", None), ("text", None), ("number", "abc"), ("number", "100")]
    df = spark.createDataFrame(values, "k string, v string")
    keys = [r[0] for r in df.select(obligations.typed_key(F.col("k"), F.col("v"))).collect()]
    assert keys == ["n:5", "n:5", "n:5.1", "text=5", "n:0", "integer~", "text~", "number=abc", "n:100"]
    events = spark.createDataFrame([(1, ["t", "u"], True), (1, ["w"], False), (2, ["t"], True)], "case int, tables array<string>, met boolean")
    need = spark.createDataFrame([(1, "t"), (1, "u"), (2, "t"), (2, "u"), (3, "t")], "case int, table string")
    assert {tuple(r) for r in obligations.tables_covered(events, need).collect()} == {(1, True), (2, False), (3, False)}
    held = obligations.holds_scalar(spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "case int, values array<string>"), spark.createDataFrame([(1, "b"), (2, "b"), (3, "b")], "case int, v string"))
    assert {tuple(r) for r in held.collect()} == {(1, True), (2, False), (3, False)}


# --- promotion


def test_restriction_runs_down_the_graph(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(5, 6), (6, 5), (None, 3), (4, None)]
    seeds = {1, 5}
    want, last = set(seeds), None
    while want != last:
        last = set(want)
        want |= {b for a, b in edges if a in want and b is not None}
    got = promotion.inherited(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(s,) for s in [*seeds, None]], "node int"))
    assert sorted(r[0] for r in got.collect()) == sorted(want) and len(want) > 5


def test_promotions_say_what_is_wrong(spark):
    claims = [("ok", 1, True, "exact", "active"), ("gone", 2, False, "exact", "active"), ("bare", 3, True, "exact", "active"), ("deep", 4, True, "exact", "active"), ("kept", 4, True, "exact", "restricted"), ("half", 1, True, "exact", "active"), ("src", 5, True, "exact", "active"), ("free", 6, True, "none", "active")]
    evidence = [("ok", 1, "e1", 10, "supports", "active", 5), ("ok", 1, "e2", 11, "contradicts", "active", 99), ("half", 1, "e1", 10, "supports", "active", 5), ("half", 1, "e2", 10, "supports", "active", 50), ("src", 5, "e1", 20, "supports", "active", 1), ("kept", 4, "e1", 10, "supports", "active", 1)]
    lineage = [(1, 10, 0, 9), (1, 10, 3, 6), (4, 10, 0, 9), (5, 20, 0, 9)]
    uses = [(100, 101), (101, 102), (102, 4)]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = promotion.promotions(
        frame(claims, "claim string, derivation int, available boolean, lineage_state string, lifecycle string"), frame(evidence, "claim string, derivation int, evidence string, source int, relation string, lifecycle string, p int"),
        frame(lineage, "derivation int, source int, lo int, hi int"), F.col("p").between(F.col("lo"), F.col("hi")), frame(uses, "src int, dst int"), frame([(100,), (20,)], "node int"),
    )
    assert {r["claim"]: r["problem"] for r in got.collect()} == {"ok": None, "gone": "origin_unavailable", "bare": "lineage_missing", "deep": "restricted_input", "kept": None, "half": "evidence_not_covered", "src": "restricted_evidence", "free": None}


# --- commits


def test_a_failure_between_families_leaves_the_old_version(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    ids = lambda *r: spark.createDataFrame([(x,) for x in r], "id int")
    links = lambda *r: spark.createDataFrame([(x,) for x in r], "claim int")
    checks = {"links have claims": orphans("links", "claim", "claims", "id"), "claims are unique": repeated("claims", "id")}
    first = store.commit("one", "d1", {"claims": ids(1, 2), "links": links(1, 1)}, checks)
    assert (first.version, first.rows, first.replayed) == (1, {"claims": 2, "links": 2}, False)

    broken = spark.createDataFrame([(3,)], "claim int").selectExpr("cast(raise_error('planted') as int) as claim")
    with pytest.raises(Exception, match="planted"):
        store.commit("two", "d2", {"claims": ids(3), "links": broken}, checks)
    with pytest.raises(CommitError, match="links have claims"):
        store.commit("three", "d3", {"claims": ids(4), "links": links(9)}, checks)
    with pytest.raises(CommitError, match="claims are unique"):
        store.commit("four", "d4", {"claims": ids(1), "links": links(1)}, checks)
    assert store.versions() == [1] and store.read("claims").count() == 2 and store.read("links").count() == 2

    again = store.commit("one", "d1", {"claims": broken}, checks)
    assert again.replayed and (again.version, again.rows) == (1, first.rows)
    with pytest.raises(CommitError, match="another content"):
        store.commit("one", "other", {"claims": ids(7)}, checks)
    assert store.commit("two", "d2", {"claims": ids(3), "links": links(3)}, checks).version == 2
    assert sorted(r[0] for r in store.read("claims").collect()) == [1, 2, 3] and store.read("claims", 1).count() == 2
    assert store.commit("five", "d5", {"claims": ids(8)}, replace=True).version == 3 and store.read("claims").count() == 1 and store.read("links").count() == 3


def test_only_one_of_two_commits_takes_a_version(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    base = store.manifest()
    store.commit("mine", "d", {"t": spark.range(1)})
    with pytest.raises(CommitError, match="taken"):
        store._publish(base | {"version": 1, "commit": "theirs"})
    assert store.manifest()["commit"] == "mine"


# --- purges


def test_bytes_live_while_an_owner_lives(spark):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    owned = purge.owners(artifact=frame([(1, "x"), (2, "y"), (3, "z"), (None, "x"), (4, None)], "owner int, object string"), result=frame([(1, "y"), (2, "z")], "owner int, object string"))
    asked = frame([("artifact", "1"), ("artifact", "1"), ("artifact", "2"), ("artifact", "3"), ("artifact", "4"), ("result", "2"), ("artifact", "77")], "kind string, owner string")
    assert {tuple(r) for r in purge.object_fates(owned, asked).collect()} == {("x", 1, 0, "delete_bytes"), ("y", 1, 1, "keep_shared"), ("z", 2, 0, "delete_bytes")}
    plan = purge.manifest("p", owned, asked)
    assert {tuple(r)[1:] for r in plan.collect()} == {("artifact", i, "scrub_payload") for i in "1234"} | {("result", "2", "scrub_payload"), ("object", "x", "delete_bytes"), ("object", "z", "delete_bytes")}
    rows = purge.scrubbed(frame([(1, "secret"), (5, "open")], "id int, text string"), "artifact", "id", ["text"], plan)
    assert {tuple(r) for r in rows.collect()} == {(1, None), (5, "open")}
    objects = frame([("x",), ("y",), ("z",)], "object string")
    left = purge.without_bytes(objects, plan)
    assert [r[0] for r in left.collect()] == ["y"]
    after = owned.withColumn("payload", ~((owned["kind"] == "artifact") | (owned["owner"] == "2")))
    assert purge.incomplete(plan, after, left).count() == 0
    half = owned.withColumn("payload", owned["owner"] != "3")
    assert {tuple(r) for r in purge.incomplete(plan, half, objects.where("object <> 'y'")).collect()} == {
        ("artifact", "1", "payload_left"), ("artifact", "2", "payload_left"), ("artifact", "4", "payload_left"), ("result", "2", "payload_left"), ("object", "x", "bytes_left"), ("object", "z", "bytes_left"), ("result", "1", "shared_bytes_lost"),
    }
