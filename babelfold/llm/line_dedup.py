"""Repeated lines across documents by a deletion-neighbourhood join.

A line is its sequence of lower-cased words.  It is dropped if an equal line,
or one within one word edit (a word changed, added or left out; for lines of
``near_words`` words or more), stands earlier: in a document of smaller
``doc_id``, or above it in its own.  Lines of fewer than ``min_words`` words
are never dropped: headings and bullets say nothing about copying.

1. One pass hashes every line and its two half-lines.  One edit leaves the
   first or the second half of a line as it is, so only lines that share a half
   with another line can have a near line; the others need no variants.
2. Those emit their deletion variants as hashed keys: the line without word i,
   for the positions in the half that differs, and the line itself.
3. Equal variants join; every line meets the earliest line of its key, never
   all the others, so a key shared by a third of all lines makes one row each.
4. The edit distance of each such pair is verified on the words.
5. Each line keeps the earliest equal or near occurrence as its origin; later
   occurrences are dropped from their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .cluster import cut, ready

MIN_WORDS, NEAR_WORDS = 5, 8
_Q = W.U(0xA24BAED4963EE407)
_QI = W.U(pow(0xA24BAED4963EE407, -1, 1 << 64))
_KIND = W.seeds(8, 21)


def _powers(q, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, q, np.uint64), dtype=np.uint64)])


class Lines:
    """Lines of consecutive texts with running sums over their word hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        is_end = data == 0x0A
        w = W.find_words(data, off)
        ends = np.flatnonzero(is_end)
        # a line ends at each \n and at each text's end
        stop = np.sort(np.concatenate([ends, off[1:]]))
        self.count = np.searchsorted(ends, off[1:]) - np.searchsorted(ends, off[:-1]) + 1
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)
        self.line = W._ramp(self.count)
        self.stop = np.searchsorted(w.start, stop)
        self.start = np.concatenate([[0], self.stop[:-1]])
        self.n = self.stop - self.start
        self.words = w
        with np.errstate(over="ignore"):
            self.qi = _powers(_QI, int(self.n.max(initial=0)) + 1)
            q = _powers(_Q, int(self.n.max(initial=0)) + 1)
            at = np.arange(len(w.hash)) - np.repeat(self.start, self.n)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * q[at], dtype=np.uint64)])

    def span(self, rows, a, b) -> np.ndarray:
        """Hash of words a..b (b excluded) of the given lines, wherever they stand in them."""
        s = self.start[rows]
        with np.errstate(over="ignore"):
            return (self.sums[s + b] - self.sums[s + a]) * self.qi[a]


def _keyed(h, kind, n, extra=0):
    with np.errstate(over="ignore"):
        return W.mix(h + _KIND[kind] + n.astype(np.uint64) * _KIND[5] + np.asarray(extra, np.uint64) * _KIND[6])


def _hasher(min_words: int, near_words: int):
    def run(batches):
        for rows, data, off in W.chunks(batches, "text"):
            x = Lines(data, off)
            at = np.flatnonzero(x.n >= min_words)
            n = x.n[at]
            zero = np.zeros_like(n)
            h = _keyed(x.span(at, zero, n), 0, n)
            near = n >= near_words
            halves = []
            for longer in (n, n + 1):  # words of the longer line of a pair
                c = longer // 2  # one edit leaves so many words whole at one end
                halves += [_keyed(x.span(at, zero, c), 1, longer), _keyed(x.span(at, n - c, n), 2, longer)]
            off4 = np.concatenate([[0], np.cumsum(np.where(near, 4, 0))])
            keys = np.stack(halves, axis=1)[near].ravel() if len(n) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c).take(pa.array(x.doc[at])) for c in (0, 1)), pa.array(x.line[at], pa.int32()), W.as_long(h),
                 W.list_of(W.as_long(keys), off4)], ["doc_id", "rid", "line", "h", "halves"])
    return run


def _variants(batches):
    """(h, doc_id, line, key, role) of lines (h, doc_id, line, text, shared halves).
    Roles: 0 a word changed at i, 1 the line itself, 2 the line without a word."""
    for b in batches:
        for rows, data, off in W.chunks(iter([b]), "text"):
            x = Lines(data, off)  # one line a row
            n = x.n
            # shared: bits of (first, last) half for a partner as long, or one word longer
            bits = rows.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            first, last = (bits & 1) > 0, (bits & 2) > 0
            lo = np.where(last, 0, n // 2)  # if the last half is shared, the edit may be in the first
            hi = np.where(first, n, n - n // 2)
            none = ~(first | last)
            lo, hi = np.where(none, 0, lo), np.where(none, 0, hi)
            m = np.maximum(hi - lo, 0)
            r = np.repeat(np.arange(len(n)), m)
            i = np.repeat(lo, m) + W._ramp(m)
            with np.errstate(over="ignore"):
                s, e = x.start[r], x.stop[r]
                rest = (x.sums[s + i] - x.sums[s]) + (x.sums[e] - x.sums[s + i + 1]) * _QI
            sub, cut_ = _keyed(rest, 3, n[r], i), _keyed(rest, 4, n[r] - 1)
            own = _keyed(x.span(np.arange(len(n)), np.zeros_like(n), n), 4, n)
            key = np.concatenate([sub, cut_, own])
            row = pa.array(np.concatenate([r, r, np.arange(len(n))]))
            role = np.repeat(np.array([0, 2, 1], np.int32), [len(r), len(r), len(n)])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(row), rows.column(1).take(row), rows.column(2).take(row),
                                              W.as_long(key), pa.array(role)], ["h", "doc_id", "line", "key", "role"])


def within_one_edit(a: list, b: list) -> bool:
    """Word sequences at most one change, addition or removal apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:] if i < len(b) else True


def _verify(batches):
    def tokens(t):
        data, off = W.buffers(pa.array([t]))
        w = W.find_words(data, off, hashes=False)
        raw = w.data.tobytes()
        return [raw[s:e] for s, e in zip(w.start.tolist(), w.end.tolist())]
    for b in batches:
        ok = [within_one_edit(tokens(x), tokens(y)) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(3)], ["h", "doc_id", "line"])


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """``(doc_id, rid, line)`` of every line to drop from ``docs(doc_id, text)``; ``rid`` is the
    hash of the text that the line stands in, lines count from 0.

    All joins are sort-merge joins, whose hot keys Spark splits: the tables that
    meet grow with the corpus, so none is broadcast at any size."""
    ready(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        "doc_id is not null and text is not null")
    # rows of one id with different texts are told apart by the texts' hash
    docs = docs.select("doc_id", F.xxhash64("text").alias("rid"), "text")
    lines = cut(docs.mapInArrow(_hasher(min_words, near_words), "doc_id long, rid long, line int, h long, halves array<long>"))
    place = F.struct("doc_id", "line", "rid")

    # lines that share a half with another line
    half = F.posexplode("halves").alias("k", "half")
    shared = cut(lines.select("h", half).groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
                 .filter("lo <> hi").select("half"))
    bit = F.expr("case when k % 2 = 0 then 1 else 2 end")
    like = cut(lines.select("h", "doc_id", "line", "rid", half).join(shared.hint("merge"), "half", "left_semi")
               .groupBy("h").agg(F.min(place).alias("at"), F.bit_or(bit).alias("bits")))
    # their words, from the text of the first of them
    per_text = like.select("h", "bits", "at.doc_id", "at.rid", "at.line").groupBy("doc_id", "rid").agg(
        F.collect_list(F.struct("line", "h", "bits")).alias("of"))
    cand = (docs.join(cut(per_text).hint("merge"), ["doc_id", "rid"])
            .select("doc_id", F.split("text", "\n").alias("t"), F.explode("of").alias("o"))
            .select("o.h", "doc_id", "o.line", F.expr("get(t, o.line)").alias("text"), "o.bits"))
    # a row that occurs twice gives its lines twice
    cand = cut(cand.filter("text is not null").groupBy("h").agg(*[F.min(c).alias(c) for c in ("doc_id", "line", "text", "bits")]))
    keyed = cand.mapInArrow(_variants, "h long, doc_id long, line int, key long, role int")

    def first(role):
        return F.min(F.when(F.col("role") == role, F.struct("doc_id", "line", "h")))

    groups = cut(keyed.groupBy("key").agg(first(0).alias("sub"), first(1).alias("own"), first(2).alias("less"),
                                          F.min("h").alias("lo"), F.max("h").alias("hi"))
                 .filter("lo <> hi").drop("lo", "hi"))
    met = F.expr("case role when 0 then sub when 1 then less else own end")
    pairs = keyed.join(groups.hint("merge"), "key").withColumn("to", met).filter(
        "to is not null and to.h <> h and struct(to.doc_id, to.line) < struct(doc_id, line)")
    pairs = pairs.groupBy("h", F.col("to.h").alias("h2")).agg(F.first("to").alias("to"))
    text = cand.select("h", "text")
    near = cut(pairs.join(text.hint("merge"), "h").join(text.select(F.col("h").alias("h2"), F.col("text").alias("text2")).hint("merge"), "h2")
               .select("h", "to.doc_id", "to.line", "text", "text2")
               .mapInArrow(_verify, "h long, doc_id long, line int"))

    # the earliest equal or near occurrence of each line that has a later one
    at = F.struct("doc_id", "line")
    origin = cut(lines.select("h", "doc_id", "line").union(near)
                 .groupBy("h").agg(F.min(at).alias("origin"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
                 .filter("n > 1").select("h", "origin"))
    return (lines.select("h", "doc_id", "rid", "line").join(origin.hint("merge"), "h")
            .filter("origin < struct(doc_id, line)").select("doc_id", "rid", "line").distinct())


def dedup_lines(docs: DataFrame, text: str = "text", dropped: str = "n_dropped", **bounds) -> DataFrame:
    """Every row of ``docs`` with its repeated lines taken out of ``text``, and
    their number in the column ``dropped`` (a column of that name is replaced);
    the lines left keep their order and form.

    A null text stays null, an empty one empty; a text may become empty.  Very
    long texts and lines are handled whole.  A null ``doc_id`` neither drops lines
    nor has any dropped.  Rows of one ``doc_id`` with the same text are alike;
    with different texts they are one document whose texts both start at line 0:
    of a line that stands in both, the one with the greater line number goes.
    All columns of ``docs`` stay, whatever their names; an empty table gives no
    rows.
    """
    kept = [c for c in docs.columns if c != dropped]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text]).alias("row"),
                         F.col("doc_id").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    packed = packed.withColumn("r", F.xxhash64("t"))
    gone = repeated_lines(packed.select(F.col("id").alias("doc_id"), F.col("t").alias("text")), **bounds)
    per_text = cut(gone.groupBy(F.col("doc_id").alias("id"), F.col("rid").alias("r")).agg(F.sort_array(F.collect_set("line")).alias("gone")))
    j = packed.join(per_text.hint("merge"), ["id", "r"], "left")
    left = F.expr("case when gone is null then t else array_join(filter(split(t, '\\n'), (x, i) -> not array_contains(gone, i)), '\\n') end")
    n = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return j.select(*[left.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept], n.alias(dropped))
