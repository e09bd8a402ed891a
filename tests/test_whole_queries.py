"""Queries over whole tables on small fixtures, against plain Python."""

from lodestone.queries import QUERIES


def test_reach_takes_the_edges_of_all_orders(spark, tmp_path):
    edges = [(1, 5, 1), (50, 5, 2), (51, 1, 3), (3, 3, 4), (4, 4, 6), (7, 102, 8), (7, 102, 8), (9, 2, 3), (10, 3, 5)]
    spark.createDataFrame(edges, "l_orderkey bigint, l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    level, want = {5}, {(5, 0)}
    for d in (1, 2, 3):
        level = {dst % 97 for _, src, dst in edges if src % 97 in level}
        want |= {(n, d) for n in level}
    got = [tuple(r) for r in QUERIES["reach_bounded_all"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_char_error_rate_takes_whole_texts(spark, tmp_path):
    texts = ["a" * 60 + "B" * 20, "Word " * 50 + "END", "q" * 300, "Short", "É" * 70 + "ß", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.cer for r in QUERIES["char_error_rate_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else distance(t, t.lower()) / max(len(t), 1) for i, t in enumerate(texts)}
    assert got[0] == 0.25


def test_parallel_edges_of_all_suppliers(spark, tmp_path):
    rows = [(1, 1, 3, 7), (2, 1, 3, 7), (3, 1, 4, 7), (4, 1, 4, 8), (4, 2, 4, 8), (5, 1, 5, None), (6, 1, 5, None), (7, 1, 6, 9)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["parallel_edges_all"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3, 7), (2, 1, 3, 7), (4, 1, 4, 8), (4, 2, 4, 8)]
