"""Benchmark passages in documents by Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive words of the benchmark items (an
item of fewer words, but not none, is one pattern).  Patterns of one length are
searched together.  For the block of two words at the end of the current window
the shift table says how far the window can move without passing a pattern: a
block that is in no pattern moves it by the pattern length less one, so most
words are never looked at.  A block that ends a pattern selects its bucket of
patterns by hash, and those are compared with the text's words directly.

Documents are read in bounded slices.  Long texts are cut into lanes of
positions that advance side by side, so one long text costs no more per word
than many short ones.  The tables of one block of items, of a bounded number of
bytes, are sent to the tasks; a larger benchmark is searched block by block.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .cluster import cut, ready

BLOCK_BYTES = 2 << 20  # benchmark text searched in one pass over the documents
LANE = 256  # positions of a lane
FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))
FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Tables:
    """Shift table, suffix buckets and patterns of one length ``m``."""

    def __init__(self, m: int, texts: list[list[bytes]], hashes: list[np.ndarray], starts: list[tuple[int, int]]):
        """``starts``: (item, first word) of each pattern."""
        self.m, self.block, self.texts = m, min(2, m), texts
        self.default = m - self.block + 1
        last: dict[int, list[tuple[int, int]]] = defaultdict(list)
        keys, moves = [], []
        for item, at in starts:
            b = self.blocks(hashes[item][at: at + m], np.arange(self.block - 1, m))
            keys.append(b), moves.append(np.arange(len(b) - 1, -1, -1))
            last[int(b[-1])].append((item, at))
        self.buckets = dict(last)
        self.suffix = np.array(sorted(self.buckets), np.uint64)
        keys, moves = np.concatenate(keys), np.concatenate(moves)
        self.bits = W.U(64 - max(10, int(len(keys) * 8).bit_length()))
        self.shift = np.full(1 << (64 - int(self.bits)), self.default, np.int16)
        np.minimum.at(self.shift, (keys >> self.bits).astype(np.int64), moves.astype(np.int16))

    def blocks(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the block of words that ends at each position."""
        with np.errstate(over="ignore"):
            return W.mix(h[end] * W.U(0x9FB21C651E98DF25) + (h[end - 1] if self.block > 1 else W.U(1)))

    def candidates(self, w: W.Words) -> np.ndarray:
        """Positions (last word) at which a pattern may end."""
        n = np.diff(w.offsets)
        docs = np.flatnonzero(n >= self.m)
        lanes = -(-(n[docs] - self.m + 1) // LANE)
        base = np.repeat(w.offsets[:-1][docs] + self.m - 1, lanes)
        pos = base + W._ramp(lanes) * LANE
        stop = np.minimum(pos + LANE, np.repeat(w.offsets[1:][docs], lanes))
        found = []
        while len(pos):
            b = self.blocks(w.hash, pos)
            move = self.shift[(b >> self.bits).astype(np.int64)].astype(np.int64)
            hit = np.flatnonzero(move == 0)
            if len(hit):
                at = np.minimum(np.searchsorted(self.suffix, b[hit]), len(self.suffix) - 1)
                found.append(np.stack([pos[hit], at])[:, self.suffix[at] == b[hit]])
            pos = pos + np.maximum(move, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)

    def occurrences(self, w: W.Words):
        """(first word, item) of each occurrence, compared word by word."""
        raw = w.data.tobytes() if len(w.data) else b""
        for end, key in self.candidates(w).T.tolist():
            first = end - self.m + 1
            text = [raw[w.start[k]: w.end[k]] for k in range(first, end + 1)]
            for item, at in self.buckets[int(self.suffix[key])]:
                if self.texts[item][at: at + self.m] == text:
                    yield first, item


def build(items: list[tuple[str, str]], window: int) -> list[Tables]:
    """One table set per pattern length of ``(item_id, text)``."""
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    texts, hashes = [], []
    data, off = W.buffers(pa.array([t for _, t in items], pa.string()))
    w = W.find_words(data, off, W.ALNUM)
    raw = w.data.tobytes()
    for k in range(len(items)):
        a, b = int(w.offsets[k]), int(w.offsets[k + 1])
        texts.append([raw[s:e] for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist())])
        hashes.append(w.hash[a:b])
        seen = set()
        for at in range(max(1, b - a - window + 1) if b > a else 0):
            p = tuple(texts[-1][at: at + window])
            if p not in seen:  # a window that an item repeats is one pattern
                seen.add(p)
                by_length[len(p)].append((k, at))
    return [Tables(m, texts, hashes, by_length[m]) for m in sorted(by_length)]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _searcher(items, window: int, text: str, carried: str | None, names: list[str], passing: list[int]):
    def run(batches):
        ids, tables = [i for i, _ in items.value], build(items.value, window)
        for rows, data, off in W.chunks(batches, text):
            w = W.find_words(data, off, W.ALNUM)
            found: dict[int, dict[str, list]] = defaultdict(lambda: defaultdict(list))
            if carried:
                for d, old in enumerate(rows.column(rows.schema.get_field_index(carried)).to_pylist()):
                    for x in old or ():
                        found[d][x["item_id"]].append((x["start"], x["end"]))
            doc_of = w.doc_of()
            for t in tables:
                for first, item in t.occurrences(w):
                    d = int(doc_of[first])
                    at = first - int(w.offsets[d])
                    found[d][ids[item]].append((at, at + t.m))
            lists, hit = [], np.zeros(rows.num_rows, np.int64)
            for d in range(rows.num_rows):
                by_item = {i: merge(r) for i, r in found[d].items()} if d in found else {}
                hit[d] = sum(e - s for s, e in merge([x for r in by_item.values() for x in r]))
                lists.append([{"item_id": i, "start": s, "end": e} for i, r in sorted(by_item.items(), key=lambda x: (x[0] or "", x[1])) for s, e in r])
            yield pa.RecordBatch.from_arrays(
                [rows.column(i) for i in passing]
                + [pa.array(np.diff(w.offsets), pa.int64()), pa.array(hit), pa.array(lists, FOUND_ARROW)], names)
    return run


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
                  columns: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``columns`` of every row of ``docs`` and its benchmark passages:
    ``n_words``, ``n_hit`` (words inside an occurrence) and ``found``, the
    ``(item_id, start, end)`` word ranges, overlapping ones of an item joined.

    A null text has no words.  Null or blank items have no pattern; a null
    ``item_id`` stays null in ``found``.  Items with equal texts are all found.
    An empty benchmark finds nothing.  Repeated rows are answered each.  Where
    ``docs`` has columns called like the new ones, leave them out of ``columns``.
    """
    spark = ready(docs)
    columns = ["doc_id"] if columns is None else list(columns)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block_of = F.pmod(F.xxhash64("text"), F.lit(blocks))
    wide = docs.select(*dict.fromkeys([*columns, text]))
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("found", FOUND)]
    out, carried = wide, None
    for b in range(blocks):
        mine = sorted((r.item_id or "", r.item_id, r.text) for r in items.filter(block_of == b).distinct().collect())
        sent = spark.sparkContext.broadcast([(i, t) for _, i, t in mine])
        last = b == blocks - 1
        keep = [c for c in wide.columns if c in columns or not last]
        schema = T.StructType([wide.schema[c] for c in keep] + new)
        passing = [wide.columns.index(c) for c in keep]
        src = out if carried is None else out.select(*wide.columns, carried)
        out = src.mapInArrow(_searcher(sent, window, text, carried, [f.name for f in schema], passing), schema)
        if not last:
            out, carried = cut(out), "found"
    return out
