import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import snapshot_diff
from lodestone.llm.snapshot_diff import later_snapshot, ranked

SCHEMA = "doc_id bigint, text string, lang string, source string, side int, row string"
FIELDS = ("text", "lang", "source")


def sha(row):
    return hashlib.sha256("\n".join("~" if v is None else v for v in row[1:]).encode()).hexdigest()


def brute(earlier, later):
    """Pairs by key, then by content and rank; keys do not repeat."""
    low = lambda k: (k is not None, k or 0)
    old, new = {r[0]: r for r in earlier}, {r[0]: r for r in later}
    out = []
    for k in old.keys() & new.keys():
        differ = [f for f, a, b in zip(FIELDS, old[k][1:], new[k][1:]) if a != b]
        out.append((k, k, "update" if differ else "same", ",".join(differ), sha(new[k])))
    left, right = defaultdict(list), defaultdict(list)
    for rows, other, into in ((old, new, left), (new, old, right)):
        for k in rows.keys() - other.keys():
            into[rows[k][1:]].append(k)
    for content in left.keys() | right.keys():
        a, b = sorted(left[content], key=low), sorted(right[content], key=low, reverse=True)
        for x, y in zip(a, b):
            out.append((y, x, "rekey", "", sha((y, *content))))
        out += [(x, x, "delete", "", None) for x in a[len(b) :]] + [(y, None, "insert", "", sha((y, *content))) for y in b[len(a) :]]
    return sorted(out, key=repr)


def diff(spark, earlier, later):
    frame = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in snapshot_diff.snapshot_diff(frame(earlier), frame(later)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    row = lambda k: (k, rng.choice([None, "", "~", "a", "a\nb", "hot", "hot", "hot"]), rng.choice([None, "en"]), rng.choice([None, "s"]))
    earlier = [row(k) for k in rng.sample(range(-150, 150), 180)] + [row(None)]
    later = [row(k) if rng.random() < 0.5 else next(r for r in earlier if r[0] == k) if k in {r[0] for r in earlier} else row(k) for k in rng.sample(range(-150, 150), 170)]
    later += [row((1 << 63) - 1), row(-(1 << 63))]
    if seed == 2:
        later.append(row(None))
    want = brute(earlier, later)
    assert diff(spark, earlier, later) == want and {r[2] for r in want} == {"same", "update", "rekey", "insert", "delete"}


def test_empty_sides_and_long_texts(spark):
    rows = [(1, "long " * 200_000, "en", None), (2, None, None, None)]
    assert diff(spark, [], []) == [] and diff(spark, rows, []) == brute(rows, []) and diff(spark, [], rows) == brute([], rows) and diff(spark, rows, rows) == brute(rows, rows)


def test_repeated_keys_pair_equal_contents_first(spark):
    earlier = [(1, "a", "l", "s"), (1, "b", "l", "s"), (1, "b", "l", "s"), (2, "x", "l", "s"), (None, "n", "l", "s"), (None, "n", "l", "s")]
    later = [(1, "b", "l", "s"), (1, "c", "l", "s"), (3, "x", "l", "s"), (4, "b", "l", "s"), (None, "n", "l", "s")]
    got = diff(spark, earlier, later)
    ops = defaultdict(int)
    for r in got:
        ops[r[2]] += 1
    # b stays once, c replaces one of the other two rows of key 1, x moves, n stays once
    assert ops["same"] == 2 and ops["update"] == 1 and len(got) == 2 + 1 + ops["rekey"] + ops["delete"] + ops["insert"]
    assert (3, 2, "rekey", "", sha((3, "x", "l", "s"))) in got and (None, None, "same", "", sha((None, "n", "l", "s"))) in got and (None, None, "delete", "", None) in got


def test_ranks_are_exact_across_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), rng.randrange(50), n) for n in range(900)]
    got = ranked(spark.createDataFrame(rows, "g string, o int, row bigint").repartition(5), ["g"], ["o"], "t").collect()
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = k
    assert {r["row"]: r["rank"] for r in got} == want


def test_later_snapshot(spark):
    from zlib import crc32

    rows = [(k, None if k % 7 == 0 else f"t{k}", "l", "s") for k in range(200)] + [(None, "t", "l", "s")]
    want = []
    for k, t, lang, s in rows:
        m = None if k is None else crc32(str(k).encode()) % 10
        if m == 0:
            continue
        new = {1: (k, (t or "") + "+", lang, s), 2: (k, t, s, lang), 3: (-1 - (k or 0), t, lang, s), 4: (-1 - (k or 0), t, lang, None)}.get(m, (k, t, lang, s))
        want += [new] + ([(-1 - k, t, lang, s)] if m == 5 else [])
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, later_snapshot(df).collect()), key=repr) == sorted(want, key=repr)
    assert later_snapshot(df).where(F.col("doc_id").isNull()).count() == 1
