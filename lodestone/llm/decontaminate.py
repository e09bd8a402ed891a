"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words (A-Z lower-cased; a word is a run of letters, digits and non-ASCII bytes) build one
suffix automaton per block of at most BLOCK_WORDS words. Documents stream through it word by word; the
automaton's state gives the longest item substring that ends at each word. Where that length reaches the
window, the last ``window`` words are an item window and are hit; an item shorter than the window is hit
where it occurs whole. States know the items they come from, so contaminated items are counted as well.

The automata are broadcast block by block: a block is bounded, and more items only mean more blocks.
Documents do not move and no document's result depends on another's.

* Null and empty texts have no words and no hits. Items without words (or null) have no windows.
* Items with one id are one item; a null item_id is listed as "null". Repeated rows are judged alike.
* Empty tables give empty results or no hits. Extra columns are ignored.
* Very long texts are read whole, word by word, in memory that grows with the text and not with its square. Ties:
  items that share a window are all counted where it occurs, and listed by id as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import in_arrow, stage
from .textnum import small

WINDOW = 10
BLOCK_WORDS = 200_000

#: Bytes that separate words become spaces, A-Z become a-z.
_TABLE = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Suffix automaton over word numbers, for items [(item_id, [word, ...])]."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]) for i, words in items if words]
        self.shortest = min((len(w) for _, w in coded), default=window)
        self.shortest = min(self.shortest, window)
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # the state of each window (its length lies in the state's range) and of each short item
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        self.window_state = [-1] * len(self.len)
        for v in sorted(range(len(self.len)), key=self.len.__getitem__):
            if self.len[v] >= window:
                p = self.link[v]
                self.window_state[v] = v if self.len[p] < window else self.window_state[p]
        for i, words in coded:
            v = 0
            for k, w in enumerate(words):
                v = self.next[v][w]
                if k + 1 >= window:
                    self.items.setdefault(self.window_state[v], set()).add(i)
            if len(words) < window:
                self.short.setdefault(v, (len(words), set()))[1].add(i)
        # nearest state on the way to the root (itself included) that holds a short item
        self.near_short = [-1] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.near_short[v] = v if v in self.short else self.near_short[self.link[v]]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = self._state(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, w, q)
        return cur

    def _state(self, n: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(n)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.len[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (start, end), merged, and the items with occurring windows."""
        if not self.vocab:
            return [], set()
        spans: list[list[int]] = []
        found: set[str] = set()
        nxt, link, length, window = self.next, self.link, self.len, self.window
        codes = np.fromiter(map(self.vocab.get, words, [0] * len(words)), np.int64, len(words))
        # only runs of known words that are long enough can hold a window
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes != 0).astype(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.shortest:
                continue
            v = n = 0
            for i, w in enumerate(codes[a:b].tolist(), a + 1):
                while v and w not in nxt[v]:
                    v = link[v]
                    n = length[v]
                v = nxt[v].get(w, 0)
                n = n + 1 if v else 0
                if n >= self.shortest:
                    if n >= window:
                        self._add(spans, i - window, i)
                        found |= self.items[self.window_state[v]]
                    s = self.near_short[v]
                    while s != -1:
                        size, ids = self.short[s]
                        if size <= n:
                            self._add(spans, i - size, i)
                            found |= ids
                        s = self.near_short[link[s]] if link[s] > 0 else -1
        return [tuple(x) for x in spans], found

    @staticmethod
    def _add(spans: list[list[int]], a: int, b: int) -> None:
        while spans and a <= spans[-1][1]:
            a = min(a, spans[-1][0])
            b = max(b, spans.pop()[1])
        spans.append([a, b])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most BLOCK_WORDS words (a longer item stands alone), partition by partition."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        w = words_of(bytes(r.t) if r.t is not None else None)
        if block and size + len(w) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.i, w))
        size += len(w)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, *keep, n_words, spans array<struct<start,end>> in words, items array<string>)."""
    sc, passes = docs.sparkSession.sparkContext, []
    source = docs.select(F.col(id_col), *keep, F.col(text_col).cast("binary").alias("_t"))
    blocks = item_blocks(benchmark, item_col, item_text_col)
    head = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "_t")
    first = next(blocks)
    second = next(blocks, None)
    if second is not None:  # several blocks: rows need a key to meet again
        source = stage(source.withColumn("_row", F.expr("uuid()")), "decon-docs")
        head += ", _row string"
    names = [c for c in source.columns if c != "_t"]

    def scanner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = shared.value
            for batch in small(batches, "_t"):
                count, spans, items = [], [], []
                for t in batch.column("_t"):
                    w = words_of(t.as_py())
                    s, i = auto.scan(w)
                    count.append(len(w))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    items.append(sorted(i))
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.record_batch({c: batch.column(c) for c in names} | {"n_words": pa.array(count, pa.int64()), "spans": pa.array(spans, span), "items": pa.array(items, pa.list_(pa.string()))})

        return run

    schema = head + ", n_words bigint, spans array<struct<start: int, end: int>>, items array<string>"

    def one(block):
        passes.append(in_arrow(source, scanner(sc.broadcast(Automaton(block, window))), schema))

    one(first)
    if second is None:
        return passes[0]
    one(second)
    for block in blocks:
        one(block)
    both = passes[0]
    for p in passes[1:]:
        both = both.unionByName(p)
    keys = [c for c in names if c != "_row"]
    out = both.groupBy("_row").agg(*[F.any_value(c).alias(c) for c in keys], F.any_value("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return out.select(*keys, "n_words", "spans", "items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Contract rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    c = contamination(docs, benchmark, window)
    # spans of one pass are disjoint; of several passes they may overlap and are merged in order
    order = F.array_sort("spans")
    hit = F.aggregate(
        order,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(x["end"] - F.greatest(s["end"], x["start"]), F.lit(0))).alias("n")),
    )["n"]
    return c.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with matched spans cut out of the text; rows whose hit words exceed
    ``drop_coverage`` of all words go. Rows without hits stay as they are, byte for byte; n_chars, if there,
    follows the text. All blocks scan the original text; coverage is tested and the text cut once, by their
    merged spans, so the number of blocks does not change the result. Null and empty texts, and very long ones
    without hits, stay as they are; rows that repeat are cut alike; an empty benchmark changes nothing."""
    sc = docs.sparkSession.sparkContext
    blocks = item_blocks(benchmark, "item_id", "text")
    out, block = docs, next(blocks)
    for following in blocks:
        out = _found(out, sc.broadcast(Automaton(block, window)), text_col)
        block = following
    return _cut(out, sc.broadcast(Automaton(block, window)), drop_coverage, text_col, docs.schema)


def word_ranges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], raw, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


#: Column, always the last, that carries the spans of the blocks before along with the uncut text.
_SPANS = "_benchmark_spans"
_SPAN_LIST = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _earlier(batch: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    """The spans found by the blocks before, row by row."""
    if batch.schema.names[-1] != _SPANS:
        return [[]] * batch.num_rows
    return [[(x["start"], x["end"]) for x in row] for row in batch.column(batch.num_columns - 1).to_pylist()]


def _found(docs: DataFrame, shared, text_col: str) -> DataFrame:
    """``docs`` with one more block's spans."""
    head = StructType([f for f in docs.schema if f.name != _SPANS])
    schema = StructType([*head, StructField(_SPANS, ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in small(batches, text_col):
            spans = []
            for t, before in zip(batch.column(batch.schema.get_field_index(text_col)), _earlier(batch)):
                t = t.as_py()
                now, _ = auto.scan(words_of(t.encode() if t is not None else None))
                spans.append([{"start": a, "end": b} for a, b in merged(before + now)])
            columns = batch.columns[: len(head)] + [pa.array(spans, _SPAN_LIST)]
            yield pa.record_batch(columns, names=[*head.names, _SPANS])

    return in_arrow(docs, run, schema)


def _cut(docs: DataFrame, shared, drop_coverage: float, text_col: str, schema: StructType) -> DataFrame:
    """The last block: coverage and cut, once, by the spans of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in small(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts, keep = [], []
            for t, before in zip(batch.column(at), _earlier(batch)):
                t = t.as_py()
                raw = t.encode() if t is not None else b""
                w = words_of(raw)
                spans, _ = auto.scan(w)
                if before:
                    spans = merged(before + spans)
                keep.append(not w or sum(b - a for a, b in spans) <= drop_coverage * len(w))
                if spans:
                    starts, ends = word_ranges(raw)
                    parts, last = [], 0
                    for a, b in spans:
                        parts.append(raw[last : starts[a]])
                        last = ends[b - 1]
                    t = (b"".join(parts) + raw[last:]).decode()
                texts.append(t)
            fields = pa.schema(list(batch.schema)[: len(schema)])
            columns = [pa.array(texts, fields.field(at).type) if k == at else c for k, c in enumerate(batch.columns[: len(schema)])]
            if (n := fields.get_field_index("n_chars")) >= 0:
                columns[n] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(fields.field(n).type)
            yield pa.record_batch(columns, schema=fields).filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs, run, schema)


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
