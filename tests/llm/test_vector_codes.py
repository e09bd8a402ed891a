import hashlib
import math
import random

import numpy as np
import pytest

from lodestone.llm import vector_codes
from lodestone.llm.vector_codes import encode

SCHEMA = "vec_id bigint, embedding array<double>, label int, pos string, h int"


def brute(rows, parts, rounds=6, entries=16, scale=4096):
    ok = [r for r in rows if r[1] is not None and len(r[1]) and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(x * scale) for x in r[1]]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    width = len(ok[0][1]) // parts
    whole = [[math.floor(x * scale) for x in r[1]] for r in ok]
    codes, errors, books = [[] for _ in ok], [0] * len(ok), []
    for p in range(parts):
        x = [v[p * width : (p + 1) * width] for v in whole]
        book = [list(v) for v in x[:entries]]
        far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
        pick = lambda v: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
        for _ in range(rounds):
            mine = {}
            for v in x:
                mine.setdefault(pick(v), []).append(v)
            for e, vs in mine.items():
                book[e] = [sum(c) // len(vs) for c in zip(*vs)]
        for i, v in enumerate(x):
            codes[i].append(pick(v))
            errors[i] += far(v, book[codes[i][-1]])
        books += [c for b in book for c in b]
    label = {}
    for r, e in zip(ok, errors):
        label[r[2]] = label.get(r[2], 0) + e
    top = (1 << 63) - 1
    errors, label = [min(e, top) for e in errors], {k: min(v, top) for k, v in label.items()}
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((r[0], r[2], tuple(c), "".join(f"{k:02x}" for k in c), e, label[r[2]], sha) for r, c, e in zip(ok, codes, errors)), key=repr)


def run(spark, rows, **o):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = encode(df, **o).collect()
    return sorted(((r["vec_id"], r["label"], tuple(r["codes"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=repr)


@pytest.mark.parametrize("seed,parts,dim", [(1, 8, 16), (2, 4, 4), (3, 3, 9)])
def test_matches_brute_force(spark, seed, parts, dim):
    rng = random.Random(seed)
    vec = lambda: [round(rng.gauss(0, 1), rng.choice([1, 3])) for _ in range(dim)]
    hot = vec()
    rows = [(k, hot if k % 3 == 0 else vec(), rng.choice([None, 0, 1, 2])) for k in rng.sample(range(500), 120)]
    rows += [(None, vec(), 1), (7, None, 1), (8, [], 1), (9, [None] * dim, 1), (10, [float("nan")] * dim, 1), (11, [float("inf")] + [0.0] * (dim - 1), 1), (900, [1.0] * (2 * parts if dim != 2 * parts else 3 * parts), 1), (901, [1.0] * (dim + 1), 1), rows[0]]
    want = brute(rows, parts)
    assert run(spark, rows, parts=parts) == want and len(want) == 122


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 8, None), (2, [-0.5] * 8, None), (3, [1e-5] * 8, 4)]
    assert run(spark, rows) == brute(rows, 8)
    for none in ([], [(1, None, 1)], [(1, [1.0] * 7, 1)]):
        assert run(spark, none) == []


def test_large_values_are_exact_and_clipped(spark):
    rows = [(k, [float(10**6 * k + i) for i in range(8)], 0) for k in range(40)]
    assert run(spark, rows) == brute(rows, 8)
    huge = [(k, [1e300 if k % 2 else -1e300] + [float(k)] * 7, 0) for k in range(20)]
    got = run(spark, huge, entries=1)
    assert len(got) == 20 and {r[4] for r in got} == {(1 << 63) - 1} and {r[5] for r in got} == {(1 << 63) - 1}


def test_nearest_is_exact_beyond_64_bits():
    x = np.array([[1 << 62, 0], [0, 5]], np.int64)
    at, far = vector_codes.nearest(x, np.array([[0, 0], [1 << 62, 1]], np.int64))
    assert list(at) == [1, 0] and list(far) == [1, 25]


def test_codes_fit_their_long(spark):
    with pytest.raises(ValueError):
        encode(spark.createDataFrame([], SCHEMA), entries=17)
