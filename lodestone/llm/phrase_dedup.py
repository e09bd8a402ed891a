"""Exact removal of repeated passages by automata over recurring stretches of words.

A word goes if it lies in a window of ``words`` words whose sequence also starts in a document with a smaller id.

* Anchors. The anchor of a window is its ``gram`` words of least hash, so equal windows have equal anchors at equal
  places. Consecutive windows that share an anchor form a stretch, of at most 2 * words - gram words.
* Recurring passages. The anchors of all documents are range-sorted by hash; those that stand alone in sorted order
  are dropped in one pass over each partition. What is left goes back to its documents, which cut out the stretches
  of recurring anchors, equal ones of a document once. Equal stretches of all documents become one row with their
  number, smallest and greatest id.
* Automata. These distinct stretches are dealt by anchor. Each task goes through its anchors in shards of about
  SHARD stretches: it confirms the windows that two documents share, word by word, compiles them into an
  Aho-Corasick automaton over the shard's vocabulary and streams the stretches through it. The smallest ids so
  found at each place of a stretch go back to all documents that have it: a window is marked in every document
  above its smallest id.
* Crowded anchors. Frequent words in ever new contexts can give an anchor an unbounded number of distinct stretches.
  The windows of an anchor with more than HOT of them are dealt one by one, by their text, instead.
* Stretches that many documents have meet their documents by broadcast (checked in size), the others by shuffle.

Documents with marks are cut; the texts of the others stay where they are while the list of marked documents is
short enough to broadcast (checked), and move once beyond.

* Null texts have no words, as have empty and blank ones; texts of fewer than ``words`` words lose nothing.
* A null id is larger than every id. Rows with equal ids do not remove each other's words.
* Rows that repeat (same id and text) get the same result. Empty tables give empty results.
* Very long texts are processed in stretches of PIECE bytes when hashed, and whole when cut. Equal hashes in a window
  give the leftmost anchor. Extra columns are ignored, whatever their names.
* Documents meet their marks by id and 64 bits of text (two times 64 bits where the id is null).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_ROWS, in_arrow, release, scratch, small_side, spread_join, stage, unstage
from .textnum import U, flat, lean, mix, powers, small, word_hashes

WORDS, GRAM = 13, 5
#: Distinct stretches from which an anchor is crowded; stretches of one automaton; windows hashed at a time.
HOT, SHARD, CHUNK = 5000, 20_000, 1 << 20
_NONE = (1 << 63) - 1
_LOW = U((1 << 24) - 1)


def _lut() -> np.ndarray:
    lut = np.arange(1, 257, dtype=U)
    lut[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return lut


def _sum(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each ``n`` consecutive word hashes."""
    p = powers(n + salt)[salt:]
    out = np.zeros(max(len(h) - n + 1, 0), U)
    for j in range(n if len(out) else 0):
        out += h[j : j + len(out)] * p[j]
    return mix(out)


def stretches(h: np.ndarray, doc: np.ndarray, words: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first window, last window, anchor hash) of word positions in ``h``; windows stay in documents."""
    for lo in range(0, len(h) - words + 1, CHUNK):
        own, d = h[lo : lo + CHUNK + words - 1], doc[lo : lo + CHUNK + words - 1]
        g = _sum(own, gram)
        low = (g & ~_LOW) | np.arange(len(g), dtype=U)
        at = low[: len(own) - words + 1]
        for j in range(1, words - gram + 1):
            at = np.minimum(at, low[j : j + len(at)])
        p = np.flatnonzero(d[: len(at)] == d[words - 1 :])
        if len(p):
            a = (at[p] & _LOW).astype(np.int64)
            new = np.ones(len(p), bool)
            new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(p)) - 1
            yield d[p[first]], p[first] + lo, p[last] + lo, g[a[first]].astype(np.int64)


def _anchor_rows(words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = _lut()
        for batch in small(batches, "_t"):
            h, doc = word_hashes(*flat(batch.column("_t")), lut)
            for d, _, _, g in stretches(h, doc, words, gram):
                order = np.lexsort((g, d))
                d, g = d[order], g[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
                rows = pa.array(d[new])
                yield pa.record_batch({"anchor": pa.array(g[new]), "_k": batch.column("_k").take(rows), "_h": batch.column("_h").take(rows)})

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition whose anchor does not stand alone. The partition's first and last rows are kept, as
    their anchor may go on in the next one."""
    held: pa.RecordBatch | None = None  # the last row seen, with whether it is kept already
    kept = True
    for batch in batches:
        if not batch.num_rows:
            continue
        a = batch.column("anchor").to_numpy()
        if held is not None and not kept and a[0] == held.column("anchor")[0].as_py():
            yield held
        same = np.append(a[1:] == a[:-1], False)
        before = held is None or a[0] == held.column("anchor")[0].as_py()
        keep = same | np.append(before, same[:-1])
        yield batch.filter(pa.array(keep))
        held, kept = batch.slice(batch.num_rows - 1), bool(keep[-1])
    if held is not None and not kept:
        yield held


def _cut(words: int, gram: int):
    """The stretches of a document's recurring anchors, with the places where it has them."""
    schema = pa.schema([("anchor", pa.int64()), ("_k", pa.int64()), ("_h", pa.int64()), ("ord", pa.int64()), ("at", pa.list_(pa.int32())), ("c", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = _lut()
        for batch in small(batches, "_t"):
            h, doc = word_hashes(*flat(batch.column("_t")), lut)
            begin = np.searchsorted(doc, np.arange(batch.num_rows))
            keys = [batch.column(c).to_numpy() for c in ("_k", "_h", "ord")]
            row, split = -1, []
            for d, p1, p2, g in stretches(h, doc, words, gram):
                ends = np.append(np.flatnonzero(np.append(d[1:] != d[:-1], True)) + 1, 0)[:-1]
                first = 0
                for end in ends.tolist():
                    i, mine = int(d[first]), slice(first, end)
                    hit = np.flatnonzero(np.isin(g[mine], batch.column("marks")[i].values.to_numpy())) + first
                    first = end
                    if not len(hit):
                        continue
                    if row != i:
                        row, split = i, batch.column("_t")[i].as_buffer().to_pybytes().split()
                    found: dict[tuple[int, bytes], list[int]] = {}
                    at = p1[hit] - begin[i]
                    for x, a, b in zip(g[hit].tolist(), at.tolist(), (at + p2[hit] - p1[hit] + words).tolist()):
                        found.setdefault((x, b" ".join(split[a:b])), []).append(a)
                    n = len(found)
                    yield pa.record_batch(
                        [pa.array([x for x, _ in found], pa.int64()), *(pa.array(np.full(n, c[i])) for c in keys), pa.array(found.values(), pa.list_(pa.int32())),
                         pa.array([c for _, c in found], pa.binary()).cast(pa.string())], schema=schema
                    )

    return run


def _few(batches: Iterator[pa.RecordBatch], least: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``least`` (the last one has what is left)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def locate(texts: list[str], low: np.ndarray, high: np.ndarray, words: int, most: int) -> np.ndarray:
    """For each text and window: the smallest id that has the window, _NONE where only one id has it.

    ``low`` and ``high`` are the least and greatest id that have the whole text."""
    number: dict[str, int] = {}
    rows = [tuple(number.setdefault(w, len(number)) for w in t.split(" ")) for t in texts]
    ids: dict[tuple[int, ...], tuple[int, int]] = {}
    for row, lo, hi in zip(rows, low.tolist(), high.tolist()):
        for p in range(len(row) - words + 1):
            a, b = ids.get(row[p : p + words], (lo, hi))
            ids[row[p : p + words]] = (min(a, lo), max(b, hi))
    out = np.full((len(rows), most), _NONE, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, (a, b) in ids.items():
        if a < b:
            automaton.add_word(window, a)
    if len(automaton):
        automaton.make_automaton()
        for i, row in enumerate(rows):
            for end, least in automaton.iter(row):
                out[i, end - words + 1] = least
    return out


def _shard(rows: pa.Table, words: int, most: int) -> pa.RecordBatch:
    """(anchor, s, lows) of the stretches of one shard that have a window of two documents."""
    rows = rows.combine_chunks()
    low, high = (rows.column(c).to_numpy() for c in ("low", "high"))
    lows = locate(rows.column("c").to_pylist(), low, high, words, most)
    hit = np.flatnonzero((lows < _NONE).any(1))
    values = pa.array(lows[hit].ravel())
    found = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1) * most, pa.int32()), values)
    taken = rows.select(["anchor", "s", "n"]).take(pa.array(hit)).combine_chunks()
    return pa.record_batch([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns), found], ["anchor", "s", "n", "lows"])


def _shards(words: int, gram: int):
    """Rows come sorted by anchor; a shard ends with an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            a = batch.column("anchor").to_numpy()
            while len(a):
                end = 0
                if held and n >= SHARD:  # up to where the held rows' last anchor ends
                    end = int(np.searchsorted(a, held[-1].column("anchor")[-1].as_py(), side="right"))
                    if end < len(a):
                        yield _shard(pa.Table.from_batches([*held, batch.slice(0, end)]), words, words - gram + 1)
                        held, n = [], 0
                        batch, a = batch.slice(end), a[end:]
                        continue
                held.append(batch)
                n += len(a)
                break
        if held:
            yield _shard(pa.Table.from_batches(held), words, words - gram + 1)
        lean()

    return run


def repeated_windows(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(_k, _h, at, bits): the windows a + i of the document, for each a in ``at`` and bit i, also start in a document
    of a smaller ``ord``. ``docs``: _k, _h, ord and the text _t."""
    if not 1 <= gram <= words or words - gram > 30:
        raise ValueError("gram has at least 1 and at most words words, and at most 30 fewer")
    parts, most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words - gram + 1
    anchors = in_arrow(docs.select("_t", "_k", "_h"), _anchor_rows(words, gram), "anchor bigint, _k bigint, _h bigint")
    dealt = anchors.repartitionByRange(parts, "anchor", "_k").sortWithinPartitions("anchor")
    marks = in_arrow(dealt, _recurring, "anchor bigint, _k bigint, _h bigint").groupBy("_k", "_h").agg(F.collect_set("anchor").alias("marks"))
    cut = _cut(words, gram)
    held = in_arrow(docs.join(marks, ["_k", "_h"]).select("_k", "_h", "ord", "_t", "marks"), lambda batches: _few(cut(batches)), "anchor bigint, _k bigint, _h bigint, ord bigint, at array<int>, c string")
    held = stage(held, "phrase-stretches")
    release(docs.sparkSession)
    distinct = held.groupBy("anchor", "c").agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.count("*").alias("n"))
    distinct = stage(distinct.withColumn("s", F.xxhash64("c")), "phrase-distinct")
    release(docs.sparkSession)
    per = stage(distinct.groupBy("anchor").agg(F.count("*").alias("w")).where("w > 1"), "phrase-anchors")
    several, crowded = per.where(F.col("w") <= HOT).select("anchor"), per.where(F.col("w") > HOT).select("anchor")
    # a stretch alone with its anchor is shared as a whole or not at all
    windows = F.size(F.split("c", " ")) - words + 1
    alone = distinct.join(small_side(per.select("anchor"), KEY_ROWS), "anchor", "left_anti").where("low < high").select("anchor", "s", "n", F.array_repeat("low", windows).alias("lows"))
    lows = [alone]
    if not crowded.isEmpty():  # at most one anchor in HOT stretches
        lows.append(_one_by_one(distinct.join(small_side(crowded, KEY_ROWS), "anchor", "left_semi"), words))
    dealt = distinct.join(small_side(several, KEY_ROWS), "anchor", "left_semi").repartition(parts, "anchor").sortWithinPartitions("anchor")
    lows.append(in_arrow(dealt, _shards(words, gram), "anchor bigint, s bigint, n bigint, lows array<bigint>"))
    found = stage(reduce(DataFrame.unionByName, lows), "phrase-lows")
    unstage(distinct)
    release(docs.sparkSession)
    met = spread_join(held.select("anchor", F.xxhash64("c").alias("s"), "_k", "_h", "ord", "at"), found, ["anchor", "s"], "n")
    bit = lambda i: F.when(F.get("lows", F.lit(i)) < F.col("ord"), F.lit(1 << i)).otherwise(0)
    return met.select("_k", "_h", "at", reduce(lambda a, b: a + b, map(bit, range(most))).cast("bigint").alias("bits")).where("bits > 0")


def _one_by_one(stretched: DataFrame, words: int) -> DataFrame:
    """What a shard would find, for stretches of crowded anchors: each window meets its smallest id by its text."""
    split = F.split("c", " ")
    windows = F.transform(F.sequence(F.lit(1), F.size(split) - words + 1), lambda i: F.array_join(F.slice(split, i, words), " "))
    rows = stretched.select("anchor", "s", "n", "low", "high", F.posexplode(windows).alias("i", "window"))
    least = rows.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("w")).where("least < most")
    met = spread_join(rows, stage(least.select("window", "least", "w"), "phrase-windows"), ["window"], "w")
    per = met.groupBy("anchor", "s", "n").agg(F.map_from_entries(F.collect_list(F.struct("i", "least"))).alias("m"))
    last = F.array_max(F.map_keys("m"))
    return per.select("anchor", "s", "n", F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(_NONE))).alias("lows"))


def _kept(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "_t"):
            total, removed, kept = [], [], []
            for text, marks in zip(batch.column("_t"), batch.column("marks")):
                split = text.as_buffer().to_pybytes().split() if text.is_valid else []
                total.append(len(split))
                if marks.is_valid:
                    places, bits = marks.values.field("at"), marks.values.field("bits").to_numpy()
                    at, bits = places.flatten().to_numpy().astype(np.int64), np.repeat(bits, pc.list_value_length(places).to_numpy())
                    change = np.zeros(len(split) + 1, np.int64)
                    for i in range(int(bits.max()).bit_length()):
                        starts = at[(bits >> i) & 1 == 1] + i
                        np.add.at(change, starts, 1)
                        np.add.at(change, starts + words, -1)
                    split = [split[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                removed.append(total[-1] - len(split))
                kept.append(b" ".join(split).decode())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def remove_phrases(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document with the words it keeps, joined by one space."""
    text = F.col("text").cast("binary")
    # a null id is larger than every id; in its place another 64 bits of the text tell documents apart
    source = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(F.lit("null"), "text")).alias("_k"), F.xxhash64("text").alias("_h"),
                         F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NONE)).alias("ord"), text.alias("_t"))
    with scratch():
        found = repeated_windows(source.select("_k", "_h", "ord", "_t"), words, gram)
        marks = stage(found.groupBy("_k", "_h").agg(F.collect_set(F.struct("at", "bits")).alias("marks")), "phrase-marks", keep=True)
    keys = small_side(marks.select("_k", "_h"), KEY_ROWS)
    whole = source.join(keys, ["_k", "_h"], "left_anti").withColumn("marks", F.lit(None).cast("array<struct<at: array<int>, bits: bigint>>"))
    cut = source.join(keys, ["_k", "_h"], "left_semi").join(marks, ["_k", "_h"])
    columns = ["doc_id", "_t", "marks"]
    id_type = dict(source.dtypes)["doc_id"]
    return in_arrow(whole.select(*columns).unionByName(cut.select(*columns)), _kept(words), f"doc_id {id_type}, n_words bigint, n_removed bigint, kept string")
