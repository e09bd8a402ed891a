"""Pairs by shared features, components, the upper median and token counts against plain Python."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import graph, relational


def pairs_by_hand(sets, k, t):
    out = {}
    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and (n >= k or n / len(sets[a] | sets[b]) >= t):
            out[a, b] = n
    return out


@pytest.mark.parametrize("k,t,hot", [(3, 0.05, 1000), (3, 0.05, 5), (3, 0.4, 0), (1, 0.9, 4), (6, 0.3, 8), (4, 1.0, 2)])
def test_shared_pairs(spark, k, t, hot):
    rng = random.Random(k * 7 + hot)
    sets = {i: {f for f in range(40) if rng.random() < (0.9 if f < 3 else 0.3 if f < 10 else 0.08)} | {100 + i % 9} for i in range(60)}
    sets |= {200: {0}, 201: {0}, 202: {0, 1, 2}, 203: set(range(40))}
    rows = spark.createDataFrame([(i, f) for i, s in sets.items() for f in s], "item int, feature int")
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in relational.shared_pairs(rows, "item", "feature", k, t, hot).collect()}
    want = pairs_by_hand(sets, k, t)
    assert {p: s for p, (s, _) in got.items()} == want and len(want) > 5
    assert all(abs(j - s / len(sets[a] | sets[b])) < 1e-12 for (a, b), (s, j) in got.items())


def test_shared_pairs_of_nothing(spark):
    assert relational.shared_pairs(spark.createDataFrame([], "item int, feature int"), "item", "feature", 2, 0.5).count() == 0


def test_a_feature_of_all_items_meets_none(spark):
    """400 items of 80 features, of which all hold one: no pair comes from it alone, and its count is still right."""
    rows = spark.range(400).select(F.col("id").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(79))).alias("k")).select("item", F.when(F.col("k") == 0, 0).otherwise(F.col("item") * 100 + F.col("k")).alias("feature"))
    twins = spark.createDataFrame([(500, f) for f in (0, 1, 2)] + [(501, f) for f in (0, 1, 2)], "item bigint, feature bigint")
    got = relational.shared_pairs(rows.where("item > 0").union(twins), "item", "feature", 3, 0.05, 100)
    assert [(r.a, r.b, r.shared) for r in got.collect() if r.a >= 500] == [(500, 501, 3)]
    assert got.count() == 1


def components_by_hand(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range((60, 140, 200, 320)[seed])]
    chain = list(range(1000, 1080))
    rng.shuffle(chain)
    edges += list(zip(chain, chain[1:])) + [(2000 - k, 2001) for k in range(50)] + [(3000, 3000 + k) for k in range(1, 40)] + [(5, 5), (4000, 4000)]
    edges += edges[:20]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == components_by_hand([(a, b) for a, b in edges if a != b])


def test_components_of_nothing(spark):
    for rows in ([], [(1, 1)]):
        assert graph.components(spark.createDataFrame(rows, "src int, dst int")).count() == 0


@pytest.mark.parametrize("most", [1, 3, 50_000])
def test_upper_median(spark, most):
    rng = random.Random(most)
    cases = [[], [None], [4.5], [2.0, 1.0], [1.0] * 9 + [5.0], [float(rng.randrange(40)) for _ in range(801)], [rng.gauss(0, 1) for _ in range(1000)] + [None] * 5]
    cases += [[-1e300, 0.0, 1e-300, 1e300, 7.0], [1.0] * 500 + [2.0] * 500, [float("nan"), 1.0, 2.0]]
    for values in cases:
        kept = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert relational.upper_median(df, "x", most) == (kept[len(kept) // 2] if kept else None)
    whole = [rng.randrange(9) for _ in range(100)]
    assert relational.upper_median(spark.createDataFrame([(v,) for v in whole], "x bigint"), "x", most) == sorted(whole)[50]


def test_multiset_sizes(spark):
    rows = [(1, "a b A  c\n"), (2, None), (3, ""), (3, "x"), (4, "b a"), (4, "B\tb"), (5, "  "), (None, "q q"), (6, "z " * 5000 + "y"), (None, "q r"), (7, None), (7, "É é")]
    got = text.multiset_sizes(spark.createDataFrame(rows, "k int, body string"), "k", F.col("body")).collect()
    want = {}
    for k, body in rows:
        want.setdefault(k, Counter()).update((body or "").lower().split())
    assert {r.k: (r.tokens, r.kinds, r.most) for r in got} == {k: (sum(c.values()), len(c), max(c.values())) for k, c in want.items() if c} and len(got) == 6
