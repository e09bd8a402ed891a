import random
import zlib

import numpy as np
import pytest

from lodestone.llm.quality import STATS, accepted, fit_rules, holds, score_quality, statistics

DOCS, LABELS = "doc_id bigint, text string, score string, n_chars bigint", "doc_id bigint, quality int, toxic int"


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("the", "on", "er", "tion", "an") for b in ("st", "ing", "e", "ou", "ly", "")]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 150))]
        good = i % 4 > 0
        t = " ".join(w) + "." if good else rng.choice([" ".join([w[0]] * 60), " ".join(x + "###" for x in w), " ".join(w).upper()])
        docs.append((i, t, "clash", len(t)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus()
    extra = [(None, None, "x", 0), (9000, "", "x", 0), (9001, None, "x", 0), docs[5]]
    got = score_quality(spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) + 4
    truth = dict((a, b) for a, b, _ in labels)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.predicted for r in out) / len(out) > 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_held_out_labels_have_no_effect(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs, DOCS)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, t) for d, q, t in labels]
    a, b = (sorted(map(tuple, score_quality(df, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, None, 0)], 0.5)])
def test_few_labels(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b", "x", 3), (2, "", "x", 0)], DOCS)
    got = score_quality(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert all(r.score == pytest.approx(score, abs=1e-6) for r in got)
    assert score_quality(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


def test_statistics_match_plain_python(spark):
    texts = ["The the cat|sat on 2 mats ##", "", None, "É é x\nY", "   ", "a"]
    got = {r.doc_id: r for r in statistics(spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], DOCS)).collect()}
    w = "the the cat|sat on 2 mats ##".split()
    assert got[0].words == len(w) and got[0].distinct == pytest.approx(len(set(w)) / len(w)) and got[0].repeat_prev == pytest.approx(1 / len(w))
    assert got[0].mean_len == pytest.approx(sum(map(len, w)) / len(w)) and got[0].top == pytest.approx(2 / len(w))
    assert got[0].pipe == pytest.approx(1 / len(texts[0])) and got[3].words == 4 and got[3].newline == pytest.approx(1 / 9)  # bytes
    assert all(getattr(got[k], s) == 0 for k in (1, 2) for s in STATS) and got[4].words == 0


def test_accepted_keeps_rows_whole(spark):
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs, DOCS)
    got = accepted(df, spark.createDataFrame(labels, LABELS))
    assert got.schema == df.schema
    kept = set(map(tuple, got.collect()))
    assert kept <= set(docs) and len(kept) > 0.9 * sum(q for _, q, _ in labels)


def test_rules_are_sparse_conjunctions():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(STATS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] < 0.3)).astype(float)
    rules, b = fit_rules(x, y)
    score = b + sum(w * holds(r, x) for w, r in rules)
    assert ((score > 0) == (y > 0.5)).mean() > 0.95 and len(rules) < 120
