"""Dictionaries, episodes, generated cases and reopened ranges against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dictionary, episodes
from lodestone.operators import cases, selectors

# --- dictionaries


def test_terms_stand_between_boundaries(spark):
    rng = random.Random(4)
    words = ["agua", "Águas", "agua potable", "plan", "Plan regulador", "niño", "x1"]
    terms = [("water", "agua"), ("water", "Agua Potable"), ("plans", "plan"), ("plans", "PLAN REGULADOR"), ("young", "nino"), ("codes", "x1"), ("other", "agua")]
    texts = [None, "", "ÁGUA", "aguas agua.", "plan-regulador, plan regulador", "x12 x1_x1"] + ["".join(rng.choice([*words, " ", " ", ", ", "-", "s"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    want = {}
    for n, text in enumerate(texts):
        for family, term in terms:
            k = len(re.findall(rf"(?<![^\W_]){re.escape(fold(term))}(?![^\W_])", fold(text or "")))
            if k:
                want[n, family, term] = k
    got = dictionary.find_terms(spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3), "id", "t", terms)
    assert {(r["id"], r["family"], r["term"]): r["n"] for r in got.collect()} == want and len(want) > 100


def test_thousands_of_terms_in_one_pass(spark):
    terms = [(f"f{k % 7}", f"term{k}") for k in range(5000)]
    got = dictionary.find_terms(spark.createDataFrame([(1, "term7 term4999, term70"), (2, "term5000")], "id int, t string"), "id", "t", terms)
    assert {(r["id"], r["term"]) for r in got.collect()} == {(1, "term7"), (1, "term4999"), (1, "term70")}
    assert dictionary.find_terms(spark.createDataFrame([(1, "a")], "id int, t string"), "id", "t", []).count() == 0
    for bad in ("", " a", "a-", "́"):
        with pytest.raises(ValueError):
            dictionary.compiled([("f", bad)])
    with pytest.raises(ValueError):
        dictionary.compiled([("f", "a" * (dictionary.MOST + 1))])


def test_routes_topics_and_patterns(spark):
    rows = [(1, "a", "x", 9), (1, "b", "y", 1), (1, "b", "z", 1), (2, "a", "x", 1), (2, "b", "y", 1), (3, "a", "x", 1), (3, "stop", "s", 1), (4, "c", "q", 1)]
    found = spark.createDataFrame(rows, "id int, family string, term string, n int")
    assert {tuple(r) for r in dictionary.routes(found, "id", ["a", "b"], "stop").collect()} == {(1, "b", 2), (2, "a", 1), (3, None, None), (4, None, None)}
    assert {r["id"]: r["topics"] for r in dictionary.topics(found, "id").collect()}[3] == ["a", "stop"]
    forms = {"law": [(r"Ley\s+(?:N°\s*)?(\d{3,5})", "Ley N° {n}")], "file": [(r"[Ee]xpediente\s+(\d{2}\.\d{3})", "Expediente {n}"), (r"exp\. (\d+)", "{n}")]}
    df = spark.createDataFrame([("Ley 7794 y Ley N° 833, expediente 21.345; exp. 9 Ley 7794",), ("",), (None,)], "t string")
    got = [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.select(dictionary.extracted(F.col("t"), forms)).collect()]
    assert got == [[("file", "9"), ("file", "Expediente 21.345"), ("law", "Ley N° 7794"), ("law", "Ley N° 833")], [], None]


# --- episodes

HEAD = """---
title: "A: record" # note
tags: [a, 'b c', "d"]
done: true
count: 12
none:
text: |
  one
    two
episodios:
  - hilo_destino: water
    fecha: 2024-01-02
    titulo: 'It''s'
    cuerpo: |
      first
      second
    cita: page 3
  - hilo_destino: roads
    fecha: 2024-1-2
    titulo: bad date
  - plain
  - hilo_destino: roads
    fecha: 2024-03-04
    titulo: "Q \\"x\\""
    tipo: nota
    cita: "> Fuente: p. 4"
---
## Episodios
#### 2024-01-01 — not this
"""


def test_heads_are_read():
    lines = HEAD.split("\n")
    end = lines.index("---", 1)
    head = episodes.parse_head(list(enumerate(lines[1:end], 2)))
    assert {k: head[k] for k in ("title", "tags", "done", "count", "none", "text")} == {"title": "A: record", "tags": ["a", "b c", "d"], "done": True, "count": 12, "none": None, "text": "one\n  two"}
    got = list(episodes.episodes(HEAD))
    assert [(e["ordinal"], e["thread"], e["title"], e["problem"]) for e in got] == [(1, "water", "It's", None), (2, "roads", "bad date", "needs date"), (3, None, None, "not a mapping"), (4, "roads", 'Q "x"', None)]
    assert got[0]["body"] == "first\nsecond" and got[0]["citation"] == "> Fuente: page 3" and got[3]["citation"] == "> Fuente: p. 4" and (got[0]["kind"], got[3]["kind"]) == ("evidencia", "nota")


@pytest.mark.parametrize("head,line,what", [("a: 'x", 2, "unclosed quote"), ("a: 1\nno key", 3, "neither key nor item"), ("a: 1\n\tb: 2", 3, "tab in the indent"), ("a: 1\na: 2", 3, "repeated key a"), ("a: [1", 2, "unclosed list"), ("a: 1\n  b: 2", 3, "wrong indent"), ("a: 1\n- b", 3, "keys and items mixed"), ("x: 'a' b", 2, "text after a quote")])
def test_malformed_heads_say_where_and_fall_back(head, line, what):
    text = f"---\n{head}\n---\n## Episodios\n### → Hilo: `t`\n#### 2024-05-06 — Title\nbody"
    got = list(episodes.episodes(text))
    assert (got[0]["origin"], got[0]["problem"], got[0]["line"]) == ("front_matter", what, line)
    assert [(e["origin"], e["thread"], e["date"], e["title"], e["body"]) for e in got[1:]] == [("headings", "t", "2024-05-06", "Title", "body")]


def brute_headings(text):
    """The section cut into blocks by a regular expression instead of a walk over its lines."""
    m = re.search(r"(?ms)^## Episodios$\n?(.*?)(?=^## (?!Episodios$)|\Z)", text)
    out, thread = [], None
    for block in re.split(r"(?m)(?=^### → Hilo: `[^`]+`\s*(?:\(condensado\))?\s*$|^#### \d{4}-\d{2}-\d{2} — .+$)", m[1] if m else ""):
        head, _, rest = block.partition("\n")
        if t := re.match(r"### → Hilo: `([^`]+)`", head):
            thread = t[1]
        elif e := re.match(r"#### (\d{4}-\d{2}-\d{2}) — (.+)$", head):
            lines = [x for x in rest.split("\n") if x != "## Episodios"]
            cited, inside, body = [], False, []
            for x in lines:
                inside = bool(x.strip()) and (inside or x.startswith("> Fuente:"))
                (cited if inside else body).append(x)
            out.append((thread, e[1], e[2], re.sub(r"\s+", "", "".join(body)), "\n".join(cited)))
    return out


def test_headings_match_brute_force(spark):
    rng = random.Random(8)
    pieces = ["## Episodios", "### → Hilo: `a b`", "### → Hilo: `c` (condensado)", "### other", "#### 2024-01-02 — One", "#### 2024-1-2 — no", "> Fuente: p", "> more", "", "text", " ## x", "#### 2024-02-03 — Two: x", "## End"]
    texts = [None, "", "---", "---\nx: 1\n"] + ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(300)]
    texts += ["## Episodios\n" + "\n".join(rng.choice(pieces[1:-1]) for _ in range(20)) for _ in range(100)]
    rows = episodes.scan_episodes(spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3), "id", "t").collect()
    seen = 0
    for n, t in enumerate(texts):
        mine = sorted((r for r in rows if r["id"] == n), key=lambda r: r["ordinal"])
        got = [(r["thread"], r["date"], r["title"], re.sub(r"\s+", "", r["body"]), r["citation"]) for r in mine]
        assert got == brute_headings(t or "")
        seen += len(got)
    assert seen > 300


# --- generated cases


def test_no_false_value_stands_in_its_table(spark):
    rng = random.Random(2)
    rows = [("t", c, float(rng.randrange(4)) if rng.random() < 0.9 else None) for c in "ab" for _ in range(8)]
    rows += [("u", "a", v) for v in (1.0, 2.0, 4.0, *(float(7 + k) for k in range(1, 12)))] + [("w", "a", 0.5), ("w", "a", None), ("x", "a", None)]
    cells = spark.createDataFrame(rows, "table string, column string, value double")
    claims = cases.counterfactual(cases.sums(cells), cells).collect()
    values = {t: {float(v) for u, _, v in rows if u == t and v is not None} for t in "tuwx"}
    totals = {(t, c): sum(v for u, d, v in rows if (u, d) == (t, c) and v is not None) for t, c in {(r[0], r[1]) for r in rows}}
    assert {(r["table"], r["column"]) for r in claims} == {("t", "a"), ("t", "b"), ("u", "a"), ("w", "a")}
    for r in claims:
        assert float(r["total"]) == totals[r["table"], r["column"]] and float(r["false_total"]) not in values[r["table"]] and r["false_total"] != r["total"]
    assert {float(r["false_total"]) for r in claims if r["table"] == "w"} == {0.51}


def test_moves_beyond_all_steps(spark):
    cells = spark.createDataFrame([("t", "a", 1.0)] + [("t", "b", float(v)) for v in range(2, 12)], "table string, column string, value double")
    got = {r["column"]: float(r["false_total"]) for r in cases.counterfactual(cases.sums(cells), cells).collect()}
    assert got["a"] == 12.0


def test_cases_are_the_same_again_and_sentinels_absent(spark):
    cells = spark.createDataFrame([("t", "a", 1.0), ("u", "a", 2.5)], "table string, column string, value double")
    none = spark.createDataFrame([], "table string, text string")
    first = {r["table"]: r["sentinel"] for r in cases.sentinels(cells, none, "s").collect()}
    taken = spark.createDataFrame([("t", first["t"])], "table string, text string")
    second = {r["table"]: r["sentinel"] for r in cases.sentinels(cells, taken, "s").collect()}
    assert second["u"] == first["u"] and second["t"] != first["t"] and second["t"].startswith("absent-")
    built = lambda seed: sorted(map(str, cases.build(cells.repartition(3), none, seed).collect()))
    assert built("s") == built("s") != built("other") and len(built("s")) == 6


# --- ranges


def test_ranges_reopen_or_say_why(spark):
    sheet = ("s", [["a", "b", "c"], ["d", None, "f"], ["g", "h", "i"]])
    tests = [
        ([sheet], "s", "B2:C3", 2, 3, [[None, "f"], ["h", "i"]], None), ([sheet], "s", "B2:C3", 2, 3, [["e", "f"], ["h", "i"]], "values_differ"), ([sheet], "s", "B2:C3", 1, 3, [[None, "f"], ["h", "i"]], "bounds_disagree"),
        ([sheet], "s", "B2:C4", 2, 4, [[None, "f"], ["h", "i"]], "range_outside"), ([sheet], "s", "C1:D1", 1, 1, [["c"]], "range_outside"), ([sheet, sheet], "s", "A1", 1, 1, [["a"]], "sheet_not_unique"),
        ([sheet], "x", "A1", 1, 1, [["a"]], "sheet_not_unique"), ([sheet], "s", "C2:B1", 1, 2, [], "bad_range"), ([sheet], "s", None, 1, 1, [], "bad_range"), ([sheet], "s", "A1", None, 1, [["a"]], "bounds_disagree"),
        ([sheet], "s", "A1", 1, 1, None, "values_differ"), ([sheet], "s", "A1", 1, 1, [["a"]], None), (None, "s", "A1", 1, 1, [["a"]], "sheet_not_unique"),
    ]
    df = spark.createDataFrame([(n, *t) for n, t in enumerate(tests)], "n int, sheets array<struct<name: string, rows: array<array<string>>>>, sheet string, a1 string, lo int, hi int, seen array<array<string>>, want string")
    for r in df.withColumn("got", selectors.range_problem(*map(F.col, ("sheets", "sheet", "a1", "lo", "hi", "seen")))).collect():
        assert r["got"] == r["want"], r
