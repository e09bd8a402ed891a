"""Candidate scores, gates, table statistics, listings, boards and routing tables against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import listing
from lodestone.operators import scoring

# --- scores


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_candidate_metrics(spark):
    rng = random.Random(1)
    for truths, candidates in (
        ([], []),
        ([(1, "must"), (2, "context")], []),
        ([(k, rng.choice(scoring.IMPORTANCE)) for k in range(30)], [(k, rng.choice(scoring.VERDICTS), rng.sample(range(30), 2)) for k in range(50)]),
    ):
        got = scoring.candidate_metrics(frame(spark, truths, "truth int, importance string"), frame(spark, candidates, "candidate int, verdict string, truths array<int>")).first()
        covered = {c[2][0] for c in candidates if c[1] == "correct"}
        share = lambda a, b: a / b if b else None
        for i in ("must", "material"):
            of = [t for t, x in truths if x == i]
            assert got[f"{i}_recall"] == share(len(covered & set(of)), len(of))
        for v, name in zip(scoring.VERDICTS, ("precision", "unsupported_rate", "redundant_rate", "overmerge_rate", "distorted_rate")):
            assert got[name] == share(sum(c[1] == v for c in candidates), len(candidates))
        assert (got["truths"], got["candidates"]) == (len(truths), len(candidates))


def test_candidate_problems(spark):
    rows = [(1, "correct", [1]), (2, "correct", [1, 2]), (3, "correct", []), (4, "overmerged", [1]), (5, "overmerged", [1, 2]), (6, "distorted", None), (7, "redundant", [9]), (8, "fine", [1]), (9, None, [1]), (10, "unsupported", [])]
    got = scoring.candidate_problems(frame(spark, rows, "candidate int, verdict string, truths array<int>"), frame(spark, [(1, "must"), (2, "must")], "truth int, importance string"))
    assert dict(map(tuple, got.collect())) == {2: "correct_needs_one_truth", 3: "correct_needs_one_truth", 4: "overmerged_needs_two_truths", 6: "needs_a_truth", 7: "unknown_truth", 8: "unknown_verdict", 9: "unknown_verdict"}


def test_verdict_scores(spark):
    i = "insufficient_evidence"
    schema = "expected string, given string, needed array<int>, cited array<int>"
    rows = [("a", "a", [1, 2], [2, 3]), ("a", i, [1], []), (i, i, [], [5]), (i, "b", None, None), ("b", "b", [4], [4])]
    assert tuple(scoring.verdict_scores(frame(spark, rows, schema)).first()) == (5, 0.6, 0.5, 0.5, 0.5)
    assert tuple(scoring.verdict_scores(frame(spark, [("a", "a", [1], None)], schema)).first()) == (1, 1.0, 0.0, 1.0, 1.0)
    assert tuple(scoring.verdict_scores(frame(spark, [(i, "a", [], [])], schema)).first()) == (1, 0.0, 1.0, 0.0, 0.0)
    assert tuple(scoring.verdict_scores(frame(spark, [], schema)).first()) == (0, None, 1.0, 1.0, 1.0)


def test_capability_states(spark):
    sha = "0" * 64
    required = [("d1", "deterministic"), ("d2", "deterministic"), ("d3", "deterministic"), ("d4", "deterministic")] + [(f"s{k}", "semantic_gold") for k in range(9)]
    cases = [
        (["d1", "d2"], "passed", None, None, None, None, None), (["d2"], "failed", None, None, None, None, None), (["d3"], None, None, None, None, None, None),
        (["s0"], "passed", False, True, True, "passed", sha), (["s1"], None, True, False, True, "passed", sha), (["s2"], None, True, True, False, "passed", sha), (["s3"], None, True, True, True, None, sha),
        (["s4", "s5"], None, True, True, True, "passed", sha), (["s5"], None, True, True, True, "failed", sha), (["s6"], None, True, True, True, "passed", "xyz"), (["s7"], None, True, None, None, None, None), (["s7"], None, None, True, True, "passed", sha),
    ]
    got = scoring.capability_states(frame(spark, required, "capability string, mode string"), frame(spark, cases, "covers array<string>, check string, scope_frozen boolean, gold_frozen boolean, adjudicated boolean, evaluation string, digest string"))
    assert {r["capability"]: r["state"] for r in got.collect()} == {
        "d1": "verified", "d2": "failed", "d3": "pending", "d4": "missing", "s0": "gold_scope_pending", "s1": "gold_pending", "s2": "adjudication_pending", "s3": "evaluation_pending", "s4": "verified", "s5": "failed", "s6": "evaluation_pending", "s7": "gold_pending", "s8": "missing",
    }


def test_cell_statistics_and_row_units(spark):
    cells = [("f", "a", 1, "string"), ("f", "a", 1, "blank"), ("f", "a", 3, "formula"), ("f", "b", 2, "blank"), ("g", "a", 1, "integer")]
    got = scoring.cell_statistics(frame(spark, cells, "file string, sheet string, row int, kind string"), frame(spark, [("f",), ("f",)], "file string"))
    assert {r["file"]: (r["sheets"], r["rows"], r["cells"], r["non_empty"], r["formulas"], r["kinds"], r["merged_ranges"]) for r in got.collect()} == {"f": (2, 5, 4, 2, 1, ["blank", "formula", "string"], 2), "g": (1, 1, 1, 1, 0, ["integer"], 0)}
    v = lambda kind: {"value": None if kind is None else {"type": kind if kind != "?" else None, "value": "x"}}
    sheets = [(1, "s", [[v("string"), v(None), v("integer")], [v("formula"), v("?")], []], ["A1:B1", "C3"]), (2, "t", [[v("string")]], None)]
    rows = scoring.row_units(frame(spark, sheets, "ordinal int, name string, rows array<array<struct<value: struct<type: string, value: string>>>>, merged_ranges array<string>")).collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: r["unit_id"])] == [
        ("1:R1", "s", 1, 2, "integer;string", False, True), ("1:R2", "s", 2, 2, "formula;unknown", True, False), ("1:R3", "s", 3, 0, "", False, True), ("2:R1", "t", 1, 1, "string", False, False),
    ]


def test_ten_facets(spark):
    rows = [("blank", None), ("string", "x"), ("integer", "5"), ("integer", "9" * 30), ("number", "2.5"), ("boolean", "true"), ("boolean", "0"), ("datetime", "2024-01-01T00:00:00"), ("formula", "=A1"), ("error", "#N/A")]
    df = frame(spark, rows, "k string, v string")
    at = {"address": F.lit("A1"), "data_type": F.lit("n"), "number_format": F.lit("General")}
    got = [tuple(r) for r in df.select(*scoring.facet_columns(F.col("k"), F.col("v"), at, "c")).collect()]
    tail = ("A1", "n", "General")
    assert [r[7:] for r in got] == [tail] * 10
    assert [r[:7] for r in got] == [
        ("blank", None, None, None, None, None, None), ("string", "x", None, None, None, None, None), ("integer", "5", 5, 5.0, None, None, None), ("integer", "9" * 30, None, float("9" * 30), None, None, None), ("number", "2.5", None, 2.5, None, None, None),
        ("boolean", "true", None, None, 1, None, None), ("boolean", "false", None, None, 0, None, None), ("datetime", "2024-01-01T00:00:00", None, None, None, "2024-01-01T00:00:00", None), ("formula", "=A1", None, None, None, None, "=A1"), ("error", "#N/A", None, None, None, None, None),
    ]


def test_routing_table(spark):
    seen = frame(spark, [("water",), ("water",), ("roads",)], "thread string")
    clusters = frame(spark, [(2, "new", "b", 1), (2, "new", "a", 5), (1, "new", "z", 1), (3, "roads", "q", 9), (4, "", "x", 1), (5, "parks", "p", 1)], "cluster int, name string, entity string, n int")
    known = frame(spark, [("water", "AYA", "Acueductos"), ("water", "AYA", "Acueductos"), ("water", "B", ""), ("parks", "P", "Parques"), ("youth", "CPJ", None)], "thread string, entity string, full string")
    got = {r["thread"]: (list(r["signals"]), list(r["entities"]), r["origin"]) for r in scoring.routing_table(seen, clusters, known).collect()}
    assert got == {
        "water": (["AYA", "Acueductos", "B"], ["AYA", "B"], "data"), "roads": ([], [], "data"), "new": (["z"], ["z"], "cluster"), "parks": (["p"], ["p"], "cluster"), "youth": (["CPJ"], ["CPJ"], "known"),
    }


# --- listings


PAGE = """<ul><li><a href="#">1999</a></li></ul><div><ul class="a fileTree b">
<li class=dir><a href="#">2023</a><ul><li class="file  ext_pdf"><a href="#" onclick="openDocumentArticle('x y.pdf')"> A &amp; <b>B</b></a></li>
<li><a href="/no">no hook</a></li><li><a onclick="other('z')">z</a></li></ul></li>
<li><a href="#">not a year</a></li><li class="file"><a onclick="openDocumentArticle('c.doc')">C</a>
<li><a href="#">2024</a></li><li><a onclick="openDocumentArticle(' ')">blank</a></li><li><a onclick="openDocumentArticle('d.xls')"></a></li></ul></div>
<ul><li><a onclick="openDocumentArticle('outside')">no</a></li></ul>"""


def test_listings(spark):
    got = [(d["ordinal"], d["year"], d["title"], d["filename"], d["source_class"]) for d in listing.documents(PAGE)]
    assert got == [(1, "2023", "A & B", "x y.pdf", "file ext_pdf"), (2, "2023", "C", "c.doc", "file"), (3, "2024", "", "d.xls", "")]
    pages = [(1, PAGE), (2, None), (3, "<ul class=fileTree><li>x</ul>"), (4, "")]
    rows = listing.scan_listings(frame(spark, pages, "id int, h string").repartition(2), "id", "h").collect()
    assert {(r["id"], r["problem"]) for r in rows} == {(1, None), (2, "no_list"), (3, "no_documents"), (4, "no_list")} and sum(r["id"] == 1 for r in rows) == 3


# --- boards


def test_entries_match_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        board = "".join(rng.choice(["- a\n", "- b c\n", "  more\n", "\n", "  - inner\n"]) for _ in range(rng.randrange(1, 9)))
        lines = board.strip().split("\n")
        first = next((k for k, x in enumerate(lines) if x.strip().startswith("- ")), None)
        want = [] if first is None else re.split(r"\n(?=- )", "\n".join(lines[first:]))
        assert listing.entries(board) == want


def test_graduation(spark):
    text = "# r\n## Tablero de anuncios\n- one\n  more\n- two\n- three\n\n## Episodios\n\n#### old\n"
    done = "# r\n## Tablero de anuncios\n- one\n  more\n\n- three\n\n## Episodios\n\n#### new\nx\n\n#### old\n"
    cases = [
        (text, [1], [" #### new\nx\n"], done, "graduated"), (text, [1], [" #### old "], text, "already_done"), (text, [], ["#### n"], text, "no_places"), (text, None, ["#### n"], text, "no_places"), (text, [1], [], text, "nothing_to_do"), (None, [1], ["n"], None, "nothing_to_do"),
        ("x", [1], ["n"], "x", "no_board"), (text.replace("## Episodios", "## E"), [0], ["#### n"], text.replace("## Episodios", "## E"), "no_episodes"),
        (text, [0, 1, 2, 9, 1], ["#### n"], "# r\n## Tablero de anuncios\n" + listing.NONE_LEFT + "\n## Episodios\n\n#### n\n\n#### old\n", "graduated"),
    ]
    df = frame(spark, [(k, *c[:3]) for k, c in enumerate(cases)], "id int, text string, places array<int>, blocks array<string>").repartition(3)
    got = {r["id"]: (r["text"], r["status"]) for r in listing.graduate(df, "id").collect()}
    for k, c in enumerate(cases):
        assert got[k] == c[3:], k
    again = {k: listing.graduated(got[k][0], *c[1:3]) for k, c in enumerate(cases) if c[4] == "graduated"}
    assert {s for _, s in again.values()} == {"already_done"} and all(t == got[k][0] for k, (t, _) in again.items())


@pytest.mark.parametrize("text", ["", "- ", "## Tablero de anuncios\n", "## Tablero de anuncios\n## Episodios\n"])
def test_boards_without_entries(text):
    assert listing.graduated(text, [0], ["x"])[1] in ("no_board", "no_episodes", "graduated")
