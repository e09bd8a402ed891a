import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate
from tests.llm.test_decontaminate import words
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_pii import brute as pii_brute

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, tmp_path):
    rng = random.Random(9)
    vocab = [a + b for a in ("the", "on", "er", "tion", "an", "ly") for b in ("st", "ing", "e", "ou", "ha", "")]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    item = prose(20)
    docs, labels = [], []
    for i in range(500):
        good, t = i % 5 > 0, prose(rng.randrange(30, 90))
        if not good:
            t = rng.choice([" ".join([t.split()[0]] * 70), " ".join(w + "###" for w in t.split())])
        if i % 50 == 1:
            t += " " + item + " tail words here."
        if i % 50 == 2:
            t += f" mail me: a{i}@example.com now"
        docs.append((i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)))
        labels.append((i, int(good), 0))
    docs += [(1000 + i, docs[i][1] + " x", "en", "s1", docs[i][4] + 2) for i in range(1, 20)] + [docs[6], docs[6], (2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, docs, dict((a, b) for a, b, _ in labels), item


def test_each_stage_does_its_work_on_what_came_before(spark, tmp_path):
    sf, docs, good, item = tables(spark, tmp_path)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, df, sf)
        if name != "mixing":
            assert out.schema == df.schema
        out.write.parquet(f"{sf}/{name}")
        df = spark.read.parquet(f"{sf}/{name}")
        rows[name] = [tuple(r) for r in df.collect()]
    kept = rows["quality"]
    assert all(k in docs for k in kept)
    bad = [r for r in kept if good.get(r[0]) == 0]
    assert len(bad) < 5 and sum(good.get(r[0], 0) for r in kept) > 0.98 * 400
    # near duplicates against brute force on the stage's own input
    want = {r[0] for r in near_brute(kept, 5) if r[3]}
    assert {r[0] for r in rows["near_duplicates"]} == want and len(rows["near_duplicates"]) == len(want)
    before = {r[0]: r for r in rows["near_duplicates"]}
    bench = " ".join(words(item))
    for r in rows["decontamination"]:
        if r[1] and bench in " ".join(words(before[r[0]][1])):
            assert bench not in " ".join(words(r[1])) and r[1].endswith("tail words here.") and r[4] == len(r[1])
        else:
            assert r == before[r[0]]
    assert {r[0] for r in rows["decontamination"]} == set(before)
    assert all(not pii_brute(r[1]) for r in rows["pii"]) and any("[EMAIL]" in (r[1] or "") for r in rows["pii"])
    assert len(rows["mixing"]) == len(rows["pii"])


def test_stages_keep_extra_columns_with_clashing_names(spark, tmp_path):
    sf, *_ = tables(spark, tmp_path)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["_k", "extra", "words", "c0", "n", "cls", "_row", "_t", "spans", "top"]
    for k, name in enumerate(names):
        df = df.withColumn(name, F.lit(k).cast("string"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, df, sf)
        assert out.schema == df.schema, name
        out.write.parquet(f"{sf}/x-{name}")
        df = spark.read.parquet(f"{sf}/x-{name}")
        assert df.where(" or ".join(f"`{c}` <> '{k}' or `{c}` is null" for k, c in enumerate(names))).isEmpty(), name
    assert corpus_pipeline.mix_sources(spark, df, sf).count() == df.count() > 300


def test_run_and_empty_tables(spark, tmp_path):
    sf, *_ = tables(spark, tmp_path / "a")
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "size", "target", "taken"} <= set(out.columns) and out.count() > 300
    e = str(tmp_path / "b")
    spark.createDataFrame([], DOCS).write.parquet(f"{e}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{e}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{e}/benchmark.parquet")
    assert corpus_pipeline.run(spark, e).count() == 0


def test_benchmark_blocks_do_not_change_the_decontamination_stage(spark, tmp_path, monkeypatch):
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    a, b, filler = run("a", 30), run("b", 30), run("f", 40)
    variant = " ".join(a.split()[25:]) + " " + run("v", 15)  # its windows overlap those of a in one text
    joined = a + " " + run("v", 15)
    items = [(1, a), (2, b), (3, variant)]
    docs = [(1, f"{a} {b} {filler}", "en", "s", 0), (2, f"{filler} {joined} {filler} end.", "en", "s", 0), (3, f"{a}. {run('g', 40)}", "en", "s", 0)]
    docs += [(4, filler, "en", "s", 7), (5, None, None, None, None), (6, "", "en", "s", 0), (7, f"{b} {a} {filler}", "en", "s", 0)]
    docs += [(8, f"{run('g', 30)} {b}, {run('h', 3)} {a} {run('k', 20)}", "en", "s", 0), (2, f"{filler} {joined} {filler} end.", "en", "s", 0)]
    df = spark.createDataFrame(docs, DOCS)
    sf, got = str(tmp_path), {}
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{sf}/benchmark.parquet")
    for size in (200_000, 20, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        out = corpus_pipeline.remove_benchmark(spark, df, sf)
        assert out.schema == df.schema
        got[size] = sorted(map(tuple, out.collect()), key=str)
    assert {r[0] for r in got[200_000]} == {2, 3, 4, 5, 6}  # 1, 7 and 8 are 60, 60 and 53 % benchmark, of two items
    text = {r[0]: r[1] for r in got[200_000]}
    assert text[2] == f"{filler}  {filler} end." and text[3] == f". {run('g', 40)}"
    assert got[20] == got[60] == got[200_000]
