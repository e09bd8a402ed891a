import hashlib
import random
from collections import Counter

import pytest

from lodestone.llm import substring_dedup
from lodestone.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id bigint, text string, n int, runs string"


def brute(rows, size):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[p : p + size] for t in raw for p in range(len(t) - size + 1))
    out = []
    for r, t in zip(rows, raw):
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n=40, size=200):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.choice([20, 45, 60, 90])) for _ in range(5)]
    out = []
    for _ in range(n):
        kind = rng.randrange(6)
        t = prose(rng.choice([3, 30, 80]))
        if kind == 1:
            t += rng.choice(shared) + prose(20)
        elif kind == 2 and out:
            t = rng.choice(out)
            at = rng.randrange(len(t) + 1)
            t = t[:at] + "#" + t[at:]
        elif kind == 3:
            t = rng.choice(shared)[rng.randrange(30) :] + t + rng.choice(shared)
        elif kind == 4:
            t = word() * rng.choice([5, 120])
        out.append(t)
    return out


@pytest.mark.parametrize("seed,size,gram,piece", [(1, 200, 64, 1 << 20), (2, 200, 64, 700), (3, 60, 16, 1 << 20)])
def test_matches_brute_force(spark, monkeypatch, seed, size, gram, piece):
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    if piece < 1000:
        monkeypatch.setattr(substring_dedup, "pieces", lambda off: ((i, i + 1) for i in range(len(off) - 1)))
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(seed))]
    rows += [(900, None, 1, "x"), (901, "", 1, "x"), (3, rows[3][1], 1, "x"), rows[3], (None, rows[5][1], 1, "x")]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), size, gram)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, size)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r)[1:4] for r in remove_repeats(spark.createDataFrame([(1, "ab" * 50, 1, "x")], SCHEMA)).collect()] == [(100, 0, 0)]
