"""Vectorised hashing of words in Arrow text buffers (numpy, no per-word Python objects).

All arithmetic is modulo 2**64. A word's hash is a polynomial of its bytes followed by an avalanche
step, so equal words have equal hashes wherever they stand, and 64-bit collisions are what remains.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
PIECE = 1 << 20

try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _TRIM = None


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a new array)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def white_lut() -> np.ndarray:
    """Word bytes are all but space and \\x09-\\x0D; A-Z count as a-z. 0: separator."""
    lut = np.arange(1, 257, dtype=U)
    lut[0x41:0x5B] += U(32)
    lut[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return lut


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a binary or string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "").cast(pa.large_binary())
    n = len(array)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1, offset=8 * array.offset) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each (a longer document stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def small(batches: Iterator[pa.RecordBatch], text: str | int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column ``text`` has about PIECE bytes in each (a longer text stands alone); freed
    memory goes back to the system in between, as a worker outlives its tasks."""
    for batch in batches:
        column = batch.column(text)
        if not batch.num_rows:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        for i, j in pieces(offsets):
            yield batch.slice(i, j - i)
        del batch, column
        lean()


def lean() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _words(data: np.ndarray, breaks: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    val = lut[data]
    is_word = val != 0
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    breaks = breaks[breaks < len(data)]
    first[breaks] = is_word[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U), starts
    span = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, span)
    val = val[starts[0] :]
    # only word bytes need a power; a long run of separators has value 0 and its index is cut to 0
    at[val == 0] = 0
    val *= powers(int(at.max()) + 1)[at]
    return mix(np.add.reduceat(val, starts - starts[0])), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the document each belongs to. Memory beyond that stays near one piece:
    a long document is cut at separators."""
    hashes, docs = [], []
    for i, j in pieces(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        while lo < hi:
            end = hi
            if hi - lo > 2 * PIECE:  # one long document
                end = lo + PIECE
                while end < hi and lut[data[end]] != 0:
                    end += 1
            h, starts = _words(data[lo:end], offsets[i:j] - lo if lo == offsets[i] else np.zeros(0, np.int64), lut)
            hashes.append(h)
            docs.append(np.searchsorted(offsets, starts + lo, side="right") - 1)
            lo = end
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, lut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of word shingles by document: (hashes, starts, sizes).

    A document of fewer words (but not none) has its whole sequence as one shingle.
    """
    h, doc = word_hashes(data, offsets, white_lut() if lut is None else lut)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    first = np.cumsum(count) - count
    keys = powers(words + 1)[1:]
    parts_h, parts_d = [], []
    if len(h) >= words:
        m = len(h) - words + 1
        acc = h[:m] * keys[0]
        for k in range(1, words):
            acc += h[k : k + m] * keys[k]
        same = doc[:m] == doc[words - 1 :]
        parts_h.append(mix(acc[same] + U(words)))
        parts_d.append(doc[:m][same])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        acc = np.zeros(len(short), U)
        for k in range(words - 1):
            use = count[short] > k
            acc[use] += h[first[short][use] + k] * keys[k]
        parts_h.append(mix(acc + count[short].astype(U)))
        parts_d.append(short)
    if not parts_h:
        return np.zeros(0, U), np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    s, d = np.concatenate(parts_h), np.concatenate(parts_d)
    if len(short):  # shingles of short documents go to their documents' places
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
    n = np.bincount(d, minlength=n_docs)
    at = np.cumsum(n) - n
    for a, b in zip(at[n > 1], (at + n)[n > 1]):
        s[a:b].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[keep], d[keep]
    n = np.bincount(d, minlength=n_docs)
    return s, np.cumsum(n) - n, n
