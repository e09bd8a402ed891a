import random
import re

import pytest

from lodestone.llm import decontaminate
from lodestone.llm.decontaminate import Automaton, decontaminated, remove_spans, sha_of

DOCS, ITEMS = "doc_id bigint, text string, item_id string, spans int", "item_id bigint, text string, items int"


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(docs, items, window=10):
    out = []
    for d, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for i, it, *_ in items:
            x = words(it)
            n = min(window, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add("null" if i is None else str(i))
        out.append((d, len(w), len(hit), len(found), sha_of(list(found)), bool(hit)))
    return sorted(out, key=str)


def data(seed, n=60):
    rng = random.Random(seed)
    vocab = ["a", "b", "C", "d9", "é", "ß"]
    text = lambda k: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(k))
    items = [(i, text(rng.choice([1, 3, 6, 8, 10, 11, 15, 30])), 0) for i in range(12)] + [(50, None, 0), (51, " . ", 0), (3, text(12), 0), (None, text(12), 0)]
    docs = []
    for i in range(n):
        t = text(rng.choice([0, 5, 20, 60]))
        if i % 2:
            t += " ".join(words(rng.choice(items)[1])).upper() + " " + text(10)
        docs.append((i, t, "x", 1))
    return docs + [(None, None, "x", 1), (7, "", "x", 1), docs[3]], items


@pytest.mark.parametrize("seed,block", [(1, 200_000), (2, 200_000), (3, 25)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = data(seed)
    got = decontaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = data(4)
    none = spark.createDataFrame([], ITEMS)
    assert decontaminated(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert not any(r.contaminated for r in decontaminated(spark.createDataFrame(docs, DOCS), none).collect())


def test_spans_are_cut_and_clean_rows_stay(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it. {item.upper()}! After it, {'word ' * 20}end.", "x", 1), (2, "Quite clean,\n\ttext.", "x", 1), (3, item, "x", 1), (4, None, None, None)]
    got = {r.doc_id: r.text for r in remove_spans(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item, 0)], ITEMS)).collect()}
    assert got == {1: f"Before it. ! After it, {'word ' * 20}end.", 2: "Quite clean,\n\ttext.", 4: None}


def test_automaton_counts_overlapping_short_items():
    auto = Automaton([("x", [b"a", b"b"]), ("y", [b"b"]), ("z", [b"a", b"b", b"a"])])
    assert auto.scan([b"a", b"b", b"a", b"q", b"b"]) == ([(0, 3), (4, 5)], {"x", "y", "z"})
