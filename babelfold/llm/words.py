"""Vectorised words of a batch of texts.

Works on the UTF-8 buffers of an Arrow string column: no Python string is made
per word.  A word gets a 64-bit hash (random byte table, odd polynomial,
splitmix finaliser); n-grams combine the hashes of their words.  All hashes are
fixed by constants here, so every task and every run agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (a bijection of 64-bit values)."""
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1 + salt * 100003, n + 1 + salt * 100003, dtype=np.uint64) * _GOLD)


_TABLE = seeds(256, 7)

# byte classes of the contracts' word patterns (whole bytes decide: UTF-8
# lead and continuation bytes are all >= 0x80 and always belong to words)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)  # of lower-cased bytes
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_pow = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 256)
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.full(size, U(_BASE)), dtype=np.uint64)
    return _pow[:n]


class Words:
    """Words of consecutive texts: ``hash``, byte ``start``/``end`` and ``offsets`` (words before each text)."""

    __slots__ = ("data", "text_off", "start", "end", "hash", "offsets")

    def __init__(self, data, text_off, start, end, hash_, offsets):
        self.data, self.text_off, self.start, self.end, self.hash, self.offsets = data, text_off, start, end, hash_, offsets

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and each row's offsets into them (a null row is empty)."""
    if pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int32)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64) if off else np.zeros(len(arr) + 1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]: off[-1]], off - off[0]


def find_words(data: np.ndarray, text_off: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = True,
               hashes: bool = True) -> Words:
    """Maximal runs of word bytes; a text's end ends a word."""
    if lower:
        data = LOWER[data]
    w = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[text_off] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.searchsorted(start, text_off)
    h = None
    if hashes:
        with np.errstate(over="ignore"):
            h = hash_spans(data, start, end)
    return Words(data, text_off, start, end, h, offsets)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``data[start:end]`` for disjoint ascending spans."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = end - start
    first = np.cumsum(n) - n
    pos = np.arange(int(n.sum())) - np.repeat(first, n)
    b = data[pos + np.repeat(start, n)]
    with np.errstate(over="ignore"):
        v = _TABLE[b] * _powers(int(n.max()))[pos]
        return mix(np.add.reduceat(v, first) + n.astype(np.uint64) * _GOLD)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words within a text, and offsets by text.
    A text of fewer words, but not none, gives its whole sequence as one."""
    counts = np.diff(words.offsets)
    m = len(words.hash)
    with np.errstate(over="ignore"):
        c = seeds(n, 3) | U(1)
        g = np.zeros(max(m - n + 1, 0), np.uint64)
        for k in range(n):
            g += words.hash[k: k + len(g)] * c[k]
            g = mix(g)
        per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
        off = np.concatenate([[0], np.cumsum(per)])
        out = np.empty(int(off[-1]), np.uint64)
        long_ = counts >= n
        # windows that stay within a text of n words or more
        src = np.repeat(words.offsets[:-1][long_], per[long_]) + _ramp(per[long_])
        dst = np.repeat(off[:-1][long_], per[long_]) + _ramp(per[long_])
        out[dst] = g[src]
        for d in np.flatnonzero((counts > 0) & ~long_):
            x = U(int(counts[d]))
            for v in words.hash[words.offsets[d]: words.offsets[d + 1]]:
                x = mix(np.asarray(x * c[0] + v))
            out[off[d]] = x
    return out, off


def _ramp(counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every segment, and the new offsets."""
    parts = [np.unique(values[off[d]: off[d + 1]]) for d in range(len(off) - 1)]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(n)])


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``size`` bytes of text at most (a longer
    text is a slice of its own): (slice, bytes, offsets).  Bounds a task's memory."""
    for batch in batches:
        col = batch.schema.get_field_index(text)
        a = 0
        data, off = buffers(batch.column(col))
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
            yield batch.slice(a, b - a), data[off[a]: off[b]], off[a: b + 1] - off[a]
            a = b


def as_long(h: np.ndarray) -> pa.Array:
    """Hashes as Spark longs (same 64 bits)."""
    return pa.array(h.view(np.int64))


def list_of(values: pa.Array, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)
