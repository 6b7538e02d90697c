"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Training takes at most ``examples`` labelled rows, the first by a hash of their
id; examples with the same set of shingles and the same label count once.  Terms
are words and their beginnings, all that at least MIN_DF examples use.  A text's
vector holds all of its terms: ``1 + log(count)`` times the inverse document
frequency times the term's relevance (:func:`relevance`): terms that tell the
labels apart, either of them, weigh more than others, none is left out.

Scoring looks up a whole text's terms in a block-max inverted index of the
examples: a block's bound is the sum of the query's weights times the block's
largest weight of each term.  The blocks of highest bounds are read first; after
that only blocks whose bound reaches the k-th cosine found so far.  So the k
nearest are exact.  A slice of texts is searched together, as arrays.

The neighbours' votes are weighted by 1 / (distance + 0.05) and calibrated by
isotonic regression of leave-one-out votes on the labels.  The neighbours are
returned as evidence.  The index has a fixed bound and is broadcast; documents
are scored where they are read, without a shuffle.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .cluster import cut, ready

EXAMPLES = 4_000  # labelled rows that training looks at, at most
MIN_DF = 2
FLOOR, CHANCE = 0.002, 20.0  # relevance of any term; chi-square that is more than chance
NEIGHBOURS, BLOCK, FIRST = 11, 64, 4  # FIRST: blocks of a query that are read before bounds are compared
STEMS = (6,)  # bytes of the beginnings of words
CELLS = 1 << 21  # (term, block) cells or postings looked up at once
COMMON, COMMON_TERMS = 1 / 16, 1024  # a term that so many of the examples use is kept as a dense column, so many terms at most


def _terms(data, off):
    """(doc, term) of each word: the word, and its beginnings, which its other forms share."""
    w = W.find_words(data, off, W.ALNUM)
    d, n = w.doc_of(), w.end - w.start
    docs, terms = [d], [w.hash]
    with np.errstate(over="ignore"):
        for k in STEMS:
            long_ = n > k
            docs.append(d[long_])
            terms.append(W.mix(W.hash_spans(w.data, w.start[long_], w.start[long_] + k) + W.U(k)))
    return np.concatenate(docs), np.concatenate(terms)


def _counted(data, off):
    """(doc, term, count) of each text, terms ascending within a text."""
    d, h = _terms(data, off)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def _examples(batches):
    """Terms of each example and the key of its whole set of shingles."""
    flip = W.seeds(1, 31)[0]
    for rows, data, off in W.chunks(batches, "text"):
        sets, goff = W.distinct(*W.ngrams(W.find_words(data, off), 3))
        size = np.diff(goff)
        keys = np.zeros((2, rows.num_rows), np.uint64)
        full = size > 0
        if full.any():
            with np.errstate(over="ignore"):
                keys[0, full] = np.add.reduceat(W.mix(sets), goff[:-1][full])
                keys[1, full] = np.add.reduceat(W.mix(sets ^ flip), goff[:-1][full]) + size[full].astype(np.uint64)
        d, h, n = _counted(data, off)
        o = np.searchsorted(d, np.arange(rows.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), W.as_long(keys[0]), W.as_long(keys[1]), W.list_of(W.as_long(h), o),
             W.list_of(pa.array(n, pa.int32()), o)], ["doc_id", "toxic", "k1", "k2", "terms", "counts"])


class Index:
    """Block-max inverted index of unit vectors, with the examples' labels and the calibration."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, ids: list, labels: np.ndarray, rows: list, prior: float):
        """``weights``: of each term; ``rows``: (term numbers, counts) of each example."""
        self.terms, self.weights, self.prior = terms, weights, prior
        vec = [self.vector(t, c) for t, c in rows]
        # examples with like terms stand together, so block bounds are tight
        order = sorted(range(len(rows)), key=lambda i: (tuple(np.asarray(rows[i][0])[np.argsort(-vec[i], kind="stable")][:8].tolist()), i))
        self.ids = [ids[i] for i in order]
        self.labels = labels[order].astype(float)
        rows, vec = [rows[i] for i in order], [vec[i] for i in order]
        n = len(rows)
        self.blocks = -(-n // BLOCK)
        t = np.concatenate([np.asarray(r[0]) for r in rows]) if n else np.zeros(0, int)
        v = np.concatenate(vec) if n else np.zeros(0)
        d = np.repeat(np.arange(n), [len(x) for x in vec]) if n else np.zeros(0, int)
        by = np.lexsort((d, t))
        self.post_term, self.post_doc, self.post_weight = t[by].astype(np.int32), d[by].astype(np.int32), v[by]
        self._build()
        self.knots = self.heights = np.zeros(0)
        self._calibrate(rows, vec)

    def _build(self) -> None:
        """The parts that follow from the postings: not sent along, built where a search needs them."""
        blocks, n = max(self.blocks, 1), len(self.ids)
        df = np.bincount(self.post_term, minlength=len(self.terms))
        often = np.argsort(-df, kind="stable")[:COMMON_TERMS]
        often = np.sort(often[df[often] > COMMON * n])
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[often] = np.arange(len(often))
        mine = self.column[self.post_term] >= 0
        self.dense = np.zeros((len(often), blocks * BLOCK))
        self.dense[self.column[self.post_term[mine]], self.post_doc[mine]] = self.post_weight[mine]
        # the others by term, then example; blocks of a term follow each other
        self.doc, self.weight = self.post_doc[~mine].astype(np.int64), self.post_weight[~mine]
        cell = self.post_term[~mine].astype(np.int64) * blocks + self.doc // BLOCK
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(self.terms) * blocks))]).astype(np.int32)
        self.top = np.zeros((len(self.terms), blocks), np.float32)
        np.maximum.at(self.top.reshape(-1), cell, self.weight.astype(np.float32) * np.float32(1 + 1e-6))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("column", "dense", "doc", "weight", "ptr", "top")}

    def vector(self, t, counts) -> np.ndarray:
        x = (1 + np.log(np.asarray(counts, float))) * self.weights[np.asarray(t, int)]
        return x / np.sqrt((x * x).sum())

    def nearest(self, t: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS, without: int = -1):
        """The k examples of highest cosine to one unit vector: (cosine, example), exact; ties by place."""
        return self.search(np.zeros(len(t), int), np.asarray(t, int), np.asarray(q, float), 1, k, np.array([without]))[0]

    def search(self, row: np.ndarray, t: np.ndarray, q: np.ndarray, n: int, k: int = NEIGHBOURS, without: np.ndarray | None = None) -> list:
        """For ``n`` unit vectors given as (row, term, weight), rows ascending: the
        k nearest examples of each, as :meth:`nearest`."""
        empty = (np.zeros(0), np.zeros(0, int))
        if not self.blocks or not len(row):
            return [empty] * n
        if "ptr" not in self.__dict__:
            self._build()
        col = self.column[t]
        common = np.zeros((n, len(self.dense)))
        common[row[col >= 0], col[col >= 0]] = q[col >= 0]
        base = common @ self.dense  # what the common terms give, for all examples
        scores = base.copy()
        row, t, q = row[col < 0], t[col < 0], q[col < 0]
        begin = np.searchsorted(row, np.arange(n + 1))
        bound = base.reshape(n, self.blocks, BLOCK).max(axis=2)
        step = max(1, CELLS // self.blocks)
        for a in range(0, len(row), step):  # bounds of a slice of the terms at a time
            part = slice(a, a + step)
            starts = np.flatnonzero(np.diff(row[part], prepend=-1))
            bound[row[part][starts]] += np.add.reduceat(q[part, None] * self.top[t[part]], starts, axis=0)
        best = np.argpartition(-bound, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST]
        first = np.zeros((n, self.blocks), bool)
        np.put_along_axis(first, best, True, axis=1)
        self._read_blocks(first, begin, t, q, scores)
        gone = np.flatnonzero(without >= 0) if without is not None else np.zeros(0, int)
        many = scores.shape[1] > k
        floor = np.full(n, -1.0)
        if best.shape[1] * BLOCK >= k:
            places = (best[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(n, -1)
            got = np.take_along_axis(scores, places, axis=1)
            if len(gone):
                got[gone] = np.where(places[gone] == without[gone, None], -1, got[gone])
            floor = np.partition(got, -k, axis=1)[:, -k]
        # equal bounds are read too: of equal cosines the first example counts
        rest = (bound > 0) & (bound * (1 + 1e-6) + 1e-9 >= floor[:, None]) & ~first
        # a row that wants most blocks reads its terms' whole lists, from the start
        whole = rest.sum(axis=1) * 4 > self.blocks
        self._read_blocks(rest & ~whole[:, None], begin, t, q, scores)
        r = np.flatnonzero(whole)
        scores[r] = base[r]
        rest[r] = True
        at, lengths = self._places(begin, r)
        lo = self.ptr[t[at].astype(np.int64) * self.blocks]
        self._add(np.repeat(r, lengths), lo, self.ptr[(t[at].astype(np.int64) + 1) * self.blocks] - lo, q[at], scores)
        if len(gone):
            scores[gone, without[gone]] = 0
        # blocks that were not read hold part of a cosine, under their bound: none is among the k
        floor = np.partition(scores, -k, axis=1)[:, -k] if many else np.zeros(n)
        out = []
        for r in range(n):
            hit = np.flatnonzero(scores[r] >= max(floor[r] - 1e-8, 1e-9))
            s = np.round(scores[r, hit], 9)
            o = np.lexsort((hit, -s))[:k]
            out.append((s[o], hit[o]) if len(hit) else empty)
        return out

    @staticmethod
    def _places(begin: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms of rows ``r``, and their numbers."""
        size = begin[r + 1] - begin[r]
        return np.repeat(begin[r], size) + W._ramp(size), size

    def _read_blocks(self, wanted: np.ndarray, begin: np.ndarray, t: np.ndarray, q: np.ndarray, scores: np.ndarray) -> None:
        """Adds to ``scores`` what the rarer terms give in the wanted (row, block) pairs."""
        r, b = np.nonzero(wanted)
        at, size = self._places(begin, r)
        cell = t[at].astype(np.int64) * self.blocks + np.repeat(b, size)
        lo = self.ptr[cell]
        self._add(np.repeat(r, size), lo, self.ptr[cell + 1] - lo, q[at], scores)

    def _add(self, row, lo, m, q, scores) -> None:
        """Adds the postings lo .. lo + m of each (row, weight), a bounded number at a time."""
        use = np.flatnonzero(m)
        row, lo, m, q = row[use], lo[use].astype(np.int64), m[use].astype(np.int64), q[use]
        ends = np.cumsum(m)
        width, a = scores.shape[1], 0
        while a < len(row):
            done = ends[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(ends, done + CELLS, side="right")))
            n = m[a:z]
            post = np.repeat(lo[a:z] - (ends[a:z] - n - done), n)
            post += np.arange(len(post))
            value = np.repeat(q[a:z], n)
            value *= self.weight[post]
            first, last = int(row[a]), int(row[z - 1]) + 1
            slot = np.repeat((row[a:z] - first) * width, n)
            slot += self.doc[post]
            scores[first:last] += np.bincount(slot, value, (last - first) * width).reshape(-1, width)
            a = z

    def vote(self, s: np.ndarray, d: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(s, 1.0))
        return float((w * self.labels[d]).sum() / w.sum())

    def _calibrate(self, rows, vec) -> None:
        raw, y = [], []
        for a in range(0, len(rows), 256):
            part = range(a, min(a + 256, len(rows)))
            row = np.repeat(np.arange(len(part)), [len(vec[i]) for i in part])
            found = self.search(row, np.concatenate([np.asarray(rows[i][0], int) for i in part]), np.concatenate([vec[i] for i in part]),
                                len(part), without=np.array(part))
            for i, (s, d) in zip(part, found):
                if len(s):
                    raw.append(self.vote(s, d)), y.append(self.labels[i])
        if not raw:
            return
        # pool adjacent violators over equal votes, with half a count for either label
        x, inverse = np.unique(np.round(raw, 6), return_inverse=True)
        n, p = np.bincount(inverse).astype(float), np.bincount(inverse, weights=np.asarray(y))
        pools: list[list[float]] = []
        for a, b, c in zip(x, p, n):
            pools.append([a, b, c])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, b2, c2 = pools.pop()
                pools[-1][1] += b2
                pools[-1][2] += c2
        self.knots = np.array([a for a, _, _ in pools])
        self.heights = np.array([(b + 0.5) / (c + 1) for _, b, c in pools])
        self.heights = np.maximum.accumulate(self.heights)
        self.prior = float(self.heights[0])  # a text without a neighbour has no toxic one

    def calibrated(self, vote: float) -> float:
        return float(self.heights[max(0, int(np.searchsorted(self.knots, round(vote, 6), side="right")) - 1)])

    def score_texts(self, doc: np.ndarray, term: np.ndarray, n: int):
        """(score, cosines, examples) of ``n`` texts from (text, term hash) of their words."""
        out = [(self.prior, np.zeros(0), np.zeros(0, int))] * n
        if not len(self.terms) or not len(self.knots) or not len(term):
            return out
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        key, count = np.unique(doc[hit].astype(np.int64) * len(self.terms) + at[hit], return_counts=True)
        row, t = np.divmod(key, len(self.terms))
        x = (1 + np.log(count)) * self.weights[t]
        x /= np.sqrt(np.bincount(row, x * x, n))[row]
        found = self.search(row, t, x, n)
        return [(self.calibrated(self.vote(s, d)), s, d) if len(s) else o for (s, d), o in zip(found, out)]


def relevance(df: np.ndarray, toxic: np.ndarray, n: int, pos: int) -> np.ndarray:
    """FLOOR, and for terms whose use and label are related beyond chance, how far the
    share of toxic examples among those that use them lies from that of all (0 to 1,
    to either side), squared."""
    neg, base = n - pos, pos / max(n, 1)
    odd = (toxic * (neg - (df - toxic)) - (df - toxic) * (pos - toxic)) ** 2
    chi2 = n * odd / np.maximum(df * (n - df) * float(max(pos * neg, 1)), 1e-9)
    rate = toxic / np.maximum(df, 1)
    lean = np.where(rate > base, (rate - base) / max(1 - base, 1e-9), (base - rate) / max(base, 1e-9))
    return FLOOR + np.where(chi2 >= CHANCE, lean ** 2, 0.0)


def train(docs: DataFrame, labels: DataFrame, fold: int | None = 1, folds: int = 3, examples: int = EXAMPLES) -> Index:
    """The index of ``labels(doc_id, toxic)`` rows of ``docs``; rows whose
    crc32 of the id falls in ``fold`` are left out.  Null ids or labels teach
    nothing; an id labelled more than once is toxic if any label says so."""
    ready(docs)
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    if fold is not None:
        lab = lab.filter(F.crc32(F.col("doc_id").cast("string")) % folds != fold)
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(cut(lab)), "doc_id").select("doc_id", "toxic", "text").mapInArrow(
        _examples, "doc_id long, toxic int, k1 long, k2 long, terms array<long>, counts array<int>")
    # copies count once for each label
    rows = rows.groupBy("k1", "k2", "toxic").agg(F.min_by(F.struct("doc_id", "terms", "counts"), "doc_id").alias("r"))
    rows = cut(rows.select("r.doc_id", "toxic", "r.terms", "r.counts"))
    # one task fits the bounded sample; the driver passes its index on
    fitted = rows.coalesce(1).sortWithinPartitions("doc_id", "toxic").mapInArrow(_fit, "index binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else Index(np.zeros(0, np.uint64), np.zeros(0), [], np.zeros(0), [], 0.5)


def _fit(batches):
    """The index of all examples (doc_id, toxic, terms, counts), in their order."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    got = pa.Table.from_batches(got).combine_chunks()
    n, toxic = len(got), np.array(got.column("toxic").to_pylist(), int)
    flat = np.concatenate([x.values.to_numpy() for x in got.column("terms")]).view(np.uint64)
    count = np.concatenate([x.values.to_numpy() for x in got.column("counts")])
    doc = np.repeat(np.arange(n), [len(x) for x in got.column("terms")])
    terms, number, df = np.unique(flat, return_inverse=True, return_counts=True)
    use = df >= MIN_DF
    weights = np.log(1 + n / df) * relevance(df.astype(float), np.bincount(number, toxic[doc], len(terms)), n, int(toxic.sum()))
    renumber = np.cumsum(use) - 1
    kept = use[number]
    doc, number, count = doc[kept], renumber[number[kept]], count[kept]
    cuts = np.searchsorted(doc, np.arange(n + 1))
    full = [i for i in range(n) if cuts[i + 1] > cuts[i]]
    vecs = [(number[cuts[i]: cuts[i + 1]], count[cuts[i]: cuts[i + 1]]) for i in full]
    ids = got.column("doc_id").to_pylist()
    index = Index(terms[use], weights[use], [ids[i] for i in full], toxic[full].astype(float), vecs, (toxic.sum() + 0.5) / (n + 1))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(index)], pa.binary())], ["index"])


EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()),
                                     T.StructField("toxic", T.IntegerType())]))
EVIDENCE_ARROW = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))


def _scorer(sent, text: str, keep: list[str], names: list[str]):
    def run(batches):
        ix = sent.value
        for rows, data, off in W.chunks(batches, text):
            for a in range(0, rows.num_rows, 512):  # bounds the scores held at once
                z = min(a + 512, rows.num_rows)
                got = ix.score_texts(*_terms(data[off[a]: off[z]], off[a: z + 1] - off[a]), z - a)
                evidence = [[{"doc_id": ix.ids[j], "cosine": float(x), "toxic": int(ix.labels[j])} for x, j in zip(s, d)] for _, s, d in got]
                part = rows.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep]
                                                 + [pa.array([g[0] for g in got], pa.float64()), pa.array(evidence, EVIDENCE_ARROW)], names)
    return run


def score_toxicity(docs: DataFrame, index: Index, text: str = "text", columns: list[str] | None = None,
                   score: str = "score", evidence: str = "evidence") -> DataFrame:
    """``columns`` of every row of ``docs``, its ``score`` (0 to 1) and ``evidence``.

    A text without a known term (null, empty and blank ones) has no neighbours: it
    gets the score of a vote without a toxic one, and no evidence.  Without
    examples that is 0.5.  Very long texts are scored whole.  Repeated rows get
    equal scores; an empty table gives no rows.  The new columns' names must not
    be among ``columns``.
    """
    spark = ready(docs)
    columns = ["doc_id"] if columns is None else list(columns)
    wide = docs.select(*dict.fromkeys([*columns, text]))
    schema = T.StructType([wide.schema[c] for c in columns] + [T.StructField(score, T.DoubleType()), T.StructField(evidence, EVIDENCE)])
    return wide.mapInArrow(_scorer(spark.sparkContext.broadcast(index), text, columns, [f.name for f in schema]), schema)
