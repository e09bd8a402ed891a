import numpy as np
import pytest

from lodestone.llm import vp_search
from lodestone.llm.vp_search import nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double"


def rows(n=3000, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    x[100:600] = x[7]  # a large group of copies
    out = [(i, [float(c) for c in v], 1, 0.5) for i, v in enumerate(x)]
    out[200] = (200, None, 1, 0.5)
    out[300] = (300, [0.0] * dim, 1, 0.5)
    out[400] = (400, [float("nan")] + [1.0] * (dim - 1), 1, 0.5)
    out[900] = (900, [None] + [1.0] * (dim - 1), 1, 0.5)
    return out + [(None, [1.0] * dim, 1, 0.5), out[50], (5000, [float("inf")] * dim, 1, 0.5), (6000, [], 1, 0.5), (7000, [1.0, 2.0], 1, 0.5), (7001, [1.0, 2.5], 1, 0.5)]


def brute(data, every=100, k=10):
    ok = [(i, np.array(v, float)) for i, v, *_ in data if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in ok:
        if i % every == 0:
            d = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = d[:k]
    return out


@pytest.mark.parametrize("size", [8 << 20, 9000])
def test_factor_one_is_exact(spark, monkeypatch, size):
    monkeypatch.setattr(vp_search, "SHARD_BYTES", size)
    data = rows()
    got = {}
    for r in nearest(spark.createDataFrame(data, SCHEMA).repartition(3), factor=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(data)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]], abs=1e-12)


def test_recall_at_the_default_factor(spark):
    data = rows(seed=3)
    want = brute(data)
    got = {}
    for r in nearest(spark.createDataFrame(data, SCHEMA)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[q] & {i for _, i in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("data", [[], [(100, [1.0], 1, 0.0)], [(None, None, None, None)]])
def test_edges(spark, data):
    assert nearest(spark.createDataFrame(data, SCHEMA)).count() == 0


def test_vectors_move_once(spark):
    plan = nearest(spark.createDataFrame(rows(1000), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1  # only the queries are copied to the shards
    assert plan.count("Exchange hashpartitioning(shard") == 1 and plan.count("Exchange") == 2
