import random

import pytest

from lodestone.llm import phrase_dedup
from lodestone.llm.phrase_dedup import remove_phrases

SCHEMA = "doc_id bigint, text string, _k string, marks int"


def brute(rows, words):
    split = [(r[1] or "").encode().split() for r in rows]
    last = 1 << 63
    key = [last if r[0] is None else r[0] for r in rows]
    low = {}
    for k, w in zip(key, split):
        for p in range(len(w) - words + 1):
            low[tuple(w[p : p + words])] = min(k, low.get(tuple(w[p : p + words]), last))
    out = []
    for r, k, w in zip(rows, key, split):
        gone = set()
        for p in range(len(w) - words + 1):
            if low[tuple(w[p : p + words])] < k:
                gone.update(range(p, p + words))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((r[0], len(w), len(gone), kept))
    return sorted(out, key=repr)


def texts(seed, n=60):
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(["a", "be", "cé", "d e", "ß", "fgh"]) + rng.choice("xyz ") for _ in range(k))
    shared, out = [prose(rng.choice([13, 14, 25, 60])) for _ in range(6)], []
    for _ in range(n):
        parts = [prose(rng.choice([0, 3, 12, 30]))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared).split(" ")
            parts += [" ".join(s[rng.randrange(3) :]), prose(rng.randrange(5))]
        if out and rng.random() < 0.2:
            parts = [rng.choice(out)]
        out.append(rng.choice([" ", "\t\n", "\x0b"]).join(parts))
    return out


@pytest.mark.parametrize("seed,hot,shard,chunk", [(1, 5000, 20_000, 1 << 20), (2, 3, 10, 40), (3, 8, 1, 1 << 20)])
def test_matches_brute_force(spark, monkeypatch, seed, hot, shard, chunk):
    for name, value in (("HOT", hot), ("SHARD", shard), ("CHUNK", chunk)):
        monkeypatch.setattr(phrase_dedup, name, value)
    rows = [(i * 7 % 61, t, "x", 1) for i, t in enumerate(texts(seed))]
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, " \n", "x", 1), rows[3], (rows[3][0], rows[4][1], "x", 1), (None, rows[5][1], "x", 1), (None, rows[5][1] + " end", "x", 1), (-5, rows[6][1], "x", 1)]
    got = remove_phrases(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = brute(rows, 13)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and sum(r[2] for r in want) > 300


def test_empty_table(spark):
    assert remove_phrases(spark.createDataFrame([], SCHEMA)).collect() == []


def test_anchors_alone_are_dropped_and_edges_kept():
    import pyarrow as pa

    batch = lambda a: pa.record_batch({"anchor": pa.array(a, pa.int64()), "_k": pa.array(range(len(a)), pa.int64()), "_h": pa.array([0] * len(a), pa.int64())})
    for cuts in ([9], [1, 8], [4, 5], [2, 2, 2, 3], [1] * 9):
        values, batches = [1, 2, 3, 3, 4, 5, 5, 5, 6], []
        for n in cuts:
            batches.append(batch(values[:n]))
            values = values[n:]
        got = [r["anchor"] for out in phrase_dedup._recurring(iter(batches)) for r in out.to_pylist()]
        assert got == [1, 3, 3, 5, 5, 5, 6]
