"""Language of a text by hierarchical discrimination.

A text is the shares of its hashed byte 1- to 3-grams (lower-cased, runs of
other characters than letters as one blank).  Two steps decide, each by
one-versus-one linear support vector machines:

1. Languages whose average shares are alike form families (average linkage,
   about the square root of the number of languages).  The machines of the root
   choose the family of a text.
2. The machines of that family choose among its closely related languages.

In both, every machine votes for one of its two classes, ties go to the greater
sum of margins.  Margins are calibrated (Platt, on rows that a machine was not
trained on); pairwise coupling gives the class's probability, and the score is
that of the family times that of the language.

Training takes a bounded sample: ``ROWS`` distinct texts or so of each of the
``LANGS`` most frequent languages, picked by hash in every task.  Families and
scales come from the sample's sums, every machine is trained in a task of its
own (dual coordinate descent over at most about 2 x ROWS rows), and the driver
receives one weight vector a machine.

Null texts and texts without a letter (empty ones too) are ``und`` with score 0
and are not trained on; without training rows all are ``und``.  Very long texts
count whole.  Rows with a null language are not trained on.  Repeated texts of a
language are trained on once.  All other columns are carried along or left out,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .cluster import cut, ready

ROWS, LANGS = 600, 64
BITS = 14
SIZE = 1 << BITS
EPOCHS, COST = 12, 10.0
UNKNOWN = "und"
LETTER = r"\p{L}"

_CLASS = np.full(256, 0x20, np.uint8)  # letters stand for themselves, bytes of other scripts too
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


class Grams:
    """Buckets of the 1- to 3-grams of consecutive texts: ``buckets`` holds an array per
    length, aligned with ``starts`` (where each text begins); SIZE marks no gram."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        b = _CLASS[W.LOWER[data]]
        b = np.append(np.insert(b, off[:-1], 0x20), 0x20).astype(np.uint8)  # a blank before each text and at the end
        first = np.zeros(len(b), bool)
        first[off[:-1] + np.arange(len(off) - 1)] = True
        first[-1] = True
        keep = first.copy()
        keep[1:] |= (b[1:] != 0x20) | (b[:-1] != 0x20)
        b, first = b[keep], first[keep]
        self.starts = np.flatnonzero(first)[:-1]
        key = b.astype(np.uint32)
        m = len(b) - 1  # the last blank only ends grams
        two, three = np.full(m, 0x20, np.uint32), np.full(m, 0x20, np.uint32)
        two[:] = key[1:]
        three[:-1] = key[2:]
        one = key[:-1]
        self.buckets = [
            np.where(one == 0x20, SIZE, _bucket(one, 1)),
            _bucket(one | (two << np.uint32(8)), 2),
            np.where(first[1:], SIZE, _bucket(one | (two << np.uint32(8)) | (three << np.uint32(16)), 3))]
        self.total = sum(np.add.reduceat((g < SIZE).astype(np.int64), self.starts) for g in self.buckets) if m else np.zeros(0)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Average weight of the grams of each text, for weights by bucket."""
        w = np.append(weights, 0).astype(np.float32)
        return sum(np.add.reduceat(w[g], self.starts, dtype=np.float64) for g in self.buckets) / np.maximum(self.total, 1)

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of text ``k`` and their shares."""
        a = self.starts[k]
        z = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.buckets[0])
        g = np.concatenate([x[a:z] for x in self.buckets])
        idx, n = np.unique(g[g < SIZE], return_counts=True)
        return idx, n / max(n.sum(), 1)

    def subset(self, rows: np.ndarray) -> Grams:
        out = object.__new__(Grams)
        ends = np.append(self.starts[1:], len(self.buckets[0]))
        size = ends[rows] - self.starts[rows]
        pick = np.repeat(self.starts[rows], size) + W._ramp(size)
        out.buckets = [g[pick] for g in self.buckets]
        out.starts, out.total = np.cumsum(size) - size, self.total[rows]
        return out


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B) * np.uint32(n)) >> np.uint32(32 - BITS)).astype(np.int32)


# ---- one machine ----------------------------------------------------------------

def train_machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by dual coordinate
    descent over sparse rows; both classes weigh the same."""
    w, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    balance = np.where(y > 0, len(y) / 2 / max((y > 0).sum(), 1), len(y) / 2 / max((y < 0).sum(), 1))
    diag = 0.5 / (cost * balance)
    q = np.array([v @ v for _, v in rows]) + 1.0 + diag
    order = np.arange(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            idx, v = rows[r]
            gain = y[r] * (w[idx] @ v + bias) - 1 + diag[r] * alpha[r]
            new = max(alpha[r] - gain / q[r], 0.0)
            if new != alpha[r]:
                step = (new - alpha[r]) * y[r]
                w[idx] += step * v
                bias += step
                alpha[r] = new
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a m + b))) of the first class."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.abs(margins).max(initial=0) or 1.0
    m, a, b = margins / scale, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3) / scale, b


def _fit(table: pa.Table, scale: np.ndarray) -> pa.Table:
    """One machine from its rows (machine, side, fold, idx, val)."""
    t = table.combine_chunks()
    y = np.array(t.column("side").to_pylist(), float)
    fold = np.array(t.column("fold").to_pylist())
    rows = [(np.array(i, np.int64), np.array(v) * scale[i]) for i, v in zip(t.column("idx").to_pylist(), t.column("val").to_pylist())]
    margins, known = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for f in (0, 1):
        rest = np.flatnonzero(fold != f)
        if len(set(y[rest])) == 2:
            w, bias = train_machine([rows[r] for r in rest], y[rest])
            for r in np.flatnonzero(fold == f):
                margins[r], known[r] = w[rows[r][0]] @ rows[r][1] + bias, True
    w, bias = train_machine(rows, y)
    a, b = platt(margins[known], y[known]) if len(set(y[known])) == 2 else (1.0, 0.0)
    return pa.table({"machine": pa.array([t.column("machine")[0].as_py()], pa.int32()), "w": pa.array([w.astype(np.float32)], pa.list_(pa.float32())),
                     "bias": [bias], "a": [a], "b": [b]})


# ---- families -------------------------------------------------------------------

def group_languages(profiles: np.ndarray) -> list[list[int]]:
    """Average linkage over the cosines of square-rooted share vectors, down to
    about the square root of their number."""
    k = len(profiles)
    p = np.sqrt(profiles)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    like = p @ p.T
    groups = [[i] for i in range(k)]
    while len(groups) > max(1, round(k ** 0.5)):
        _, a, b = max((like[np.ix_(x, y)].mean(), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[-a] += groups.pop(-b)
    return [sorted(g) for g in groups]


@dataclass
class Machine:
    left: int      # classes: families in the root, languages in a family
    right: int
    weights: np.ndarray
    bias: float
    a: float
    b: float


@dataclass
class Model:
    languages: list[str]
    families: list[list[int]]
    root: list[Machine]
    within: list[list[Machine]]  # by family


def _features(batches):
    for rows, data, off in W.chunks(batches, "text"):
        g = Grams(data, off)
        got = [g.of(k) for k in range(rows.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array([i for i, _ in got], pa.list_(pa.int32())),
             pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))], ["lang", "pick", "idx", "val"])


def _profile(batches):
    """Sums of the shares of a task's rows by language (a row per language)."""
    sums: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for batch in batches:
        for lang, idx, val in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            s = sums.setdefault(lang, np.zeros(SIZE))
            s[idx.values.to_numpy()] += val.values.to_numpy()
            count[lang] = count.get(lang, 0) + 1
    for lang, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.int32()), pa.array([count[lang]], pa.int64()), pa.array([s], pa.list_(pa.float64()))],
                                         ["lang", "n", "s"])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(LETTER), F.lit(False))


def train(rows: DataFrame, text: str = "text", lang: str = "lang", per_language: int = ROWS, languages: int = LANGS) -> Model:
    """Machines from labelled ``rows``; see the module text for the sample."""
    spark = ready(rows)
    rows = rows.select(F.col(f"`{lang}`").cast("string").alias("name"), F.lower(F.col(f"`{text}`").cast("string")).alias("text"))
    rows = rows.filter(F.col("name").isNotNull() & has_letter(F.col("text")))
    counts = rows.groupBy("name").count().orderBy(F.desc("count"), "name").limit(languages).collect()
    names = sorted(r.name for r in counts)
    if not names:
        return Model([], [], [], [])
    known = spark.createDataFrame([(r.name, names.index(r.name), min(1.0, per_language / r["count"])) for r in counts],
                                  "name string, lang int, share double")
    # a uniform number in [0, 1) for each text
    pick = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = (rows.join(F.broadcast(known), "name").withColumn("pick", pick).filter("pick < share")
            .groupBy("lang", "pick").agg(F.first("text").alias("text"), F.first("share").alias("share")))
    feats = cut(some.select("lang", (F.col("pick") / F.col("share")).alias("pick"), "text")
                .mapInArrow(_features, "lang int, pick double, idx array<int>, val array<float>"))
    sums, sizes = np.zeros((len(names), SIZE)), np.zeros(len(names))
    merged = (feats.select("lang", "idx", "val").mapInArrow(_profile, "lang int, n long, s array<double>")
              .groupBy("lang").applyInArrow(_add_profiles, "lang int, n long, s array<double>"))
    for r in merged.collect():  # a row per language
        sums[r.lang], sizes[r.lang] = r.s, r.n
    profiles = sums / np.maximum(sizes, 1)[:, None]
    families = group_languages(profiles)
    # frequent grams must not outweigh the others
    scale = 1 / np.sqrt(profiles.mean(axis=0) + 1e-4)

    members, machines = [], []  # (machine, language, side, share of its rows)

    def pairs(node, classes):
        for i in range(len(classes)):
            for j in range(i + 1, len(classes)):
                m = len(machines)
                machines.append((node, i, j))
                for side, c in ((1, classes[i]), (-1, classes[j])):
                    members.extend((m, lang_, side, 1.0 / len(c)) for lang_ in c)
    pairs(-1, families)
    for f, group in enumerate(families):
        pairs(f, [[x] for x in group])
    model = Model(names, families, [], [[] for _ in families])
    if not machines:
        return model
    of = spark.createDataFrame(members, "machine int, lang int, side int, part double")
    mine = (feats.join(F.broadcast(of), "lang").filter("pick < part")
            .select("machine", "side", F.expr("cast(floor(pick * 65536) % 2 as int)").alias("fold"), "idx", "val"))

    def fit(t: pa.Table) -> pa.Table:
        return _fit(t, scale)

    for r in mine.groupBy("machine").applyInArrow(fit, "machine int, w array<float>, bias double, a double, b double").collect():
        node, i, j = machines[r.machine]
        (model.root if node < 0 else model.within[node]).append(Machine(i, j, np.array(r.w, np.float32) * scale.astype(np.float32), r.bias, r.a, r.b))
    return model


def _add_profiles(t: pa.Table) -> pa.Table:
    total = np.zeros(SIZE)
    for batch in t.to_batches():
        for s in batch.column(batch.schema.get_field_index("s")):
            total += s.values.to_numpy()
    return pa.table({"lang": t.column("lang").slice(0, 1), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()),
                     "s": pa.array([total], pa.list_(pa.float64()))})


# ---- prediction -----------------------------------------------------------------

def choose(grams: Grams, machines: list[Machine], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of every text among ``k`` and its probability."""
    n = len(grams.starts)
    if k == 1:
        return np.zeros(n, int), np.ones(n)
    votes, margin, inverse = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    for m in machines:
        s = grams.scores(m.weights) + m.bias
        p = np.clip(1 / (1 + np.exp(-np.clip(m.a * s + m.b, -30, 30))), 1e-12, 1 - 1e-12)
        votes[:, m.left] += s > 0
        votes[:, m.right] += s <= 0
        margin[:, m.left] += s
        margin[:, m.right] -= s
        inverse[:, m.left] += 1 / p
        inverse[:, m.right] += 1 / (1 - p)
    best = np.lexsort((margin, votes), axis=1)[:, -1] if n else np.zeros(0, int)
    prob = 1 / np.maximum(inverse[np.arange(n), best] - (k - 2), 1)
    return best, prob


def _predict(model: Model):
    def run(batches):
        for rows, data, off in W.chunks(batches, "text"):
            g = Grams(data, off)
            n = rows.num_rows
            family, p = choose(g, model.root, len(model.families))
            lang = np.zeros(n, int)
            for f, group in enumerate(model.families):
                at = np.flatnonzero(family == f)
                if len(at):
                    best, q = choose(g.subset(at) if len(at) < n else g, model.within[f], len(group))
                    lang[at] = np.array(group)[best]
                    p[at] *= q
            letter = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(lang.tolist(), letter.tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names), pa.array(np.where(letter, np.clip(p, 0, 1), 0.0))],
                                             ["row", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None,
             pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``columns`` of ``docs`` (all of them by default) with the language of ``text`` and its score."""
    ready(docs)
    columns = docs.columns if columns is None else columns
    t = F.col(f"`{text}`").cast("string")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.lower(t).alias("text"), has_letter(t).alias("letter"))
    if model.languages:
        schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
        packed = packed.mapInArrow(_predict(model), schema)
    else:
        packed = packed.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return packed.select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("lang_pred").alias(pred), F.col("score").alias(score))
