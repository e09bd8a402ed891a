import random
import zlib

import numpy as np

from lodestone.llm.language import DENSITY, SLOTS, Filter, grams, identify, language_id, learn, slots

SCHEMA = "doc_id bigint, text string, lang string, score string"
PARTS = {"en": ["the", "tion", "and", "ing", "wh", "ly"], "de": ["sch", "ung", "der", "ß", "zu", "ä"], "fr": ["que", "eau", "ç", "les", "é", "ai"]}


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", "fr"])
        out.append((i, " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang if i % 10 else None, "x"))
    return out


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    odd = [(9000, None, "en", "x"), (9001, "", "en", "x"), (9002, "12 34 !?", "de", "x"), (None, "the tion and", None, "x"), (9003, "жук", None, "x"), (9004, "the andtion and wh" * 200_000, "en", "x"), rows[4]]
    got = language_id(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r[0]: r[2] for r in rows if r[2]}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 50 and sum(truth[r.doc_id] == r.lang_pred for r in out) / len(out) > 0.97
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (9000, 9001, 9002)] == ["und"] * 3 and by[9003].lang_pred == "en" and by[9004].lang_pred == "en"
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_no_training_rows(spark):
    assert [r.lang_pred for r in language_id(spark.createDataFrame([(1, "abc", None, "x")], SCHEMA)).collect()] == ["und"]
    assert language_id(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_returns_all_languages_of_a_gram(spark):
    model = learn(spark.createDataFrame([("abcdabcd abcd", "en"), ("abcdxyzu abcd xyzu", "de"), ("xyzu xyzu xyzu", "fr")], "text string, lang string"))
    data = np.frombuffer(b"abcd", np.uint8)
    got = model.corrected(model.counts(*grams(data, np.array([0, 4])), 1))[0]
    assert {model.langs[k] for k in range(3) if got[k] > 0.9} == {"en", "de"}


def test_false_positive_correction_is_unbiased():
    rng = np.random.default_rng(0)
    masks = np.zeros((1, SLOTS), np.uint64)
    for at in slots(rng.integers(0, 1 << 31, 120_000).astype(np.uint32)):
        masks[0, at] |= np.uint64(1)
    model = Filter(["en"], [1.0], masks)
    g = rng.integers(1 << 31, 1 << 32, 50_000).astype(np.uint32)
    raw = np.ones(len(g), bool)
    for at in slots(g):
        raw &= masks[0, at] > 0
    assert raw.mean() > 0.2 and model.corrected(model.counts(g, np.zeros(len(g), int), 1))[0, 0] < 0.03 * len(g)


def test_a_language_with_one_short_text_is_found(spark):
    train = [(t, lang) for _, t, lang, _ in corpus(200) if lang] + [("llwybr cyhoeddus", "cy")]
    model = learn(spark.createDataFrame(train, "text string, lang string"))
    got = identify(spark.createDataFrame([(1, "Cyhoeddus llwybr"), (2, "llwybr"), (3, "the tion and wh")], "doc_id bigint, text string"), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "cy", 2: "cy", 3: "en"}


def test_the_filter_grows_with_the_ngrams(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(150_000))
    model = learn(spark.createDataFrame([(text, "en"), ("der sch ung", "de")], "text string, lang string"))
    assert model.false.max() <= 1.05 * DENSITY**3 and model.masks.shape[1] > SLOTS


def test_only_letters_make_a_language_and_long_texts_are_read_in_stretches(spark):
    from lodestone.llm.language import has_letter, identify, learn

    assert not any(has_letter(x.encode()) for x in ("²", "½ 3", "Ⅷ", "123 _ %", ""))
    assert all(has_letter(x.encode()) for x in ("é", "1а", "ª", "中", "x"))
    en, fr = "the cat and the dog on the mat ", "le chat et la souris dans la maison "
    model = learn(spark.createDataFrame([(en * 20, "en"), (fr * 20, "fr")], "text string, lang string"))
    long = fr * 90_000 + en * 60_000  # 5 MB, in stretches
    rows = spark.createDataFrame([(1, long), (2, en), (3, "²½Ⅷ"), (4, "²" * 5_000_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in identify(rows, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["fr", "en", "und", "und"] and 0.5 < got[1].score < 0.9
