import re

import pytest

from lodestone.llm.mixing import mix, targets

SCHEMA = "doc_id bigint, text string, source string, target int, lam string"


def water(sizes, weights, cap=3):
    """Excess reshared by weight until none is above its limit."""
    t, free, left = {}, dict(weights), sum(sizes.values())
    while free:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return t | share
        for s in over:
            t[s] = cap * sizes[s]
            left -= t[s]
            del free[s]
    return t


def rows(n=3000):
    out = []
    for i in range(n):
        s = "a" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None
        out.append((i, " ".join(["w"] * (1 + (i * i) % (400 if i % 50 else 5000))), s, 1, "x"))
    return out + [(9000, None, "a", 1, "x"), (9001, "", "zz", 1, "x"), (None, "a b", "s1", 1, "x"), (9005, "a b c", "s1", 1, "x"), (9005, "a b c", "s1", 1, "x")]


def test_mix_reaches_targets_and_reruns_agree(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = mix(df.repartition(3)).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, s, *_ in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted([s for s in sizes if s is not None]) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    by_id = {r[0]: r[2] for r in data}
    taken = {}
    for r in got:
        s = by_id[r.doc_id] if r.doc_id is not None else "s1"
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=30), s
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(2)).collect()))


@pytest.mark.parametrize("data", [[], [(1, None, None, 1, "x")], [(1, "a", "s", 1, "x")], [(1, "a b", None, 1, "x"), (1, "a b", None, 1, "x")]])
def test_edges(spark, data):
    got = mix(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    assert sum(r.taken for r in got) == sum(len((t[1] or "").split()) for t in data)


def test_targets_reshare_excess(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 0), (None, 70)], "source string, size bigint")
    got = {r.source: r.target for r in targets(df).collect()}
    want = water({"a": 10, "b": 1000, "c": 500, "d": 0, None: 70}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2})
    assert got == pytest.approx(want)
