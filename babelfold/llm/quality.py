"""Quality rules: fixed base rules, then robust multivariate outliers.

Every text becomes a vector of transformed statistics.  For each language and
source a minimum-covariance-determinant estimate is made of the vectors that
pass the base rules.  Fixed starts are the medians with the quartiles, and the
rows on either side of each statistic's median; junk that stands apart in some
statistic is missing from one of them.  From each, concentration steps keep the
``keep_share`` of rows nearest to the current centre and take their mean and
covariance anew; the start that reaches the least determinant goes on.  All
rows near its result then give the mean and covariance that count, so up to
nearly half of a group may be junk.  A row is rejected if its squared
Mahalanobis distance, scaled to the chi-square median of those rows, is beyond
the chi-square quantile ``confidence``.

The covariance has a floor per statistic (``FLOORS``): many statistics are
constant in clean text, and the first symbol in a text is no outlier.  All is
aggregates with map-side partials per group, so a group with a third of all
rows costs one partial row a task.  Groups of fewer than ``min_rows`` rows are
pooled by language; a pool that is still smaller takes the estimate of all rows,
and where all rows are fewer, nothing is rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .cluster import cut, ready, small

NAMES = ("word_length", "symbols", "punctuation", "capitals", "repeats", "same_lines")
FLOORS = (0.10, 0.60, 0.30, 0.10, 0.25, 0.25)  # least standard deviation of each
KEEP_SHARE, STEPS, MIN_ROWS, CONFIDENCE = 0.5, 3, 60, 0.9999  # STEPS from every start, and again from the best
NEAR, REWEIGHTS = 0.975, 2  # chi-square quantile up to which rows count in the end
ALL = "*"  # the group of all rows
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punct", "n_upper")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _PUNCT[_a:_b] = False
_CHAR = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def _again(doc: np.ndarray, h: np.ndarray):
    """For each value whether it was seen before in its text, and whether it is seen twice there."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    before, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    before[order] = same
    twice[order] = same | np.append(same[1:], False)
    return before, twice


def text_counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """COUNTS of consecutive texts."""
    w = W.find_words(data, off, lower=False)
    word_byte = W.NOT_SPACE[data]
    n_words = np.diff(w.offsets)
    # lines: text between newlines; those without a word don't count
    lines = W.find_words(data, off, W.NOT_NEWLINE, lower=False)
    has_word = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    line_doc = lines.doc_of()
    same, _ = _again(line_doc[has_word], lines.hash[has_word])
    rows = len(off) - 1
    dup = np.bincount(line_doc[has_word], weights=same, minlength=rows).astype(np.int64)
    n_lines = np.bincount(line_doc[has_word], minlength=rows)
    # words under a three-word window that the text has twice
    doc = w.doc_of()
    cover = np.zeros(len(doc), bool)
    if len(doc) >= 3:
        inside = doc[2:] == doc[:-2]
        g, goff = W.ngrams(w, 3)
        first = np.flatnonzero(inside)
        whole = np.repeat(n_words >= 3, np.diff(goff))  # shorter texts give their whole sequence
        _, twice = _again(doc[first], g[whole])
        at = first[twice]
        for k in range(3):
            cover[at + k] = True
    repeat = _per_text(cover, w.offsets)
    return [n_words, _per_text(word_byte & _CHAR[data], off), _per_text(_SYMBOL[data], off), dup, repeat, n_lines,
            _per_text(_PUNCT[data], off), _per_text(_UPPER[data], off)]


def _counter(text: str, keep: list[str], names: list[str]):
    def run(batches):
        for rows, data, off in W.chunks(batches, text):
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in keep]
                                             + [pa.array(x, pa.int64()) for x in text_counts(data, off)], names)
    return run


def statistics(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``columns`` and COUNTS of every row; a null text counts as empty."""
    ready(docs)
    wide = docs.select(*dict.fromkeys([*columns, text]))
    schema = T.StructType([wide.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in COUNTS])
    return wide.mapInArrow(_counter(text, columns, [f.name for f in schema]), schema)


def vector() -> Column:
    """The transformed statistics, in the order of NAMES."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return F.array(F.log(chars / n), F.log1p(100 * F.col("n_symbols") / n), F.log(0.05 + F.col("n_punct") / n),
                   F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_upper") / chars))), F.col("n_repeat_words") / n,
                   F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))


def chi2_quantile(p: float, k: int) -> float:
    """Wilson-Hilferty."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def consistency(share: float, k: int) -> float:
    """By how much the covariance of the innermost ``share`` of normal vectors of an even dimension is too small."""
    x = chi2_quantile(share, k) / 2
    return share / (1 - math.exp(-x) * sum(x ** i / math.factorial(i) for i in range(k // 2 + 1)))


def _inverse(batches):
    """(g, s, centre, cov) -> (g, s, centre, precision, log of the determinant): one small matrix a row."""
    p = len(FLOORS)
    for b in batches:
        cov = [np.array(c, float).reshape(p, p) + np.diag(np.square(FLOORS)) for c in b.column(3).to_pylist()]
        inv = [np.linalg.inv(c).ravel().tolist() for c in cov]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(inv, pa.list_(pa.float64())),
                                          pa.array([np.linalg.slogdet(c)[1] for c in cov], pa.float64())], ["g", "s", "centre", "precision", "det"])


def _inverted(moments: DataFrame) -> DataFrame:
    return cut(moments.select("g", "s", "centre", "cov").mapInArrow(_inverse, "g string, s int, centre array<double>, precision array<double>, det double"))


def _distance() -> Column:
    p = len(FLOORS)
    d = [f"(x[{i}] - centre[{i}])" for i in range(p)]
    return F.expr(" + ".join(f"precision[{i * p + j}] * {d[i]} * {d[j]}" for i in range(p) for j in range(p)))


def _moments(rows: DataFrame) -> DataFrame:
    """(g, s, centre, cov) of the vectors of each group and start."""
    p = len(FLOORS)
    mean = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(p)]
    cov = [F.covar_pop(F.col("x")[i], F.col("x")[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)]
    return rows.groupBy("g", "s").agg(*mean, *cov).select("g", "s", F.array(*[f"m{i}" for i in range(p)]).alias("centre"), F.array(
        *[f"c{min(i, j)}{max(i, j)}" for i in range(p) for j in range(p)]).alias("cov"))


def _starts(rows: DataFrame) -> DataFrame:
    """(g, s, centre, cov): start 0 from medians and quartiles, the others from the rows on either side of a median."""
    p = len(FLOORS)
    quart = [F.percentile_approx(F.col("x")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000) for i in range(p)]
    q = cut(rows.groupBy("g").agg(*[c.alias(f"q{i}") for i, c in enumerate(quart)]))
    spread = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) for i in range(p)]
    middle = q.select("g", F.lit(0).alias("s"), F.array(*[F.col(f"q{i}")[1] for i in range(p)]).alias("centre"),
                      F.array(*[spread[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("cov"))
    sides = [F.when(c, F.lit(k)) for i in range(p) for c, k in ((F.col("x")[i] <= F.col(f"q{i}")[1], 2 * i + 1), (F.col("x")[i] >= F.col(f"q{i}")[1], 2 * i + 2))]
    halves = rows.join(small(q), "g").select("g", "x", F.explode(F.array_compact(F.array(*sides))).alias("s"))
    return middle.union(_moments(halves))


def _far(rows: DataFrame, now: DataFrame) -> DataFrame:
    return rows.join(small(now), "g").select("g", "s", "x", _distance().alias("d"))


def _quantile(far: DataFrame, share: float) -> DataFrame:
    return cut(far.groupBy("g", "s").agg(F.percentile_approx("d", share, 10_000).alias("limit")))


def estimates(rows: DataFrame, keep_share: float = KEEP_SHARE, steps: int = STEPS) -> DataFrame:
    """``rows(g, x)`` -> ``(g, centre, precision, scale)``, one row a group."""
    p = len(FLOORS)
    now = _inverted(_starts(rows))
    for step in range(2 * steps):
        far = _far(rows, now)
        now = _inverted(_moments(far.join(small(_quantile(far, keep_share)), ["g", "s"]).filter("d <= limit")))
        if step == steps - 1:
            best = now.groupBy("g").agg(F.min(F.struct("det", "s", "centre", "precision")).alias("b"))
            now = cut(best.select("g", "b.s", "b.centre", "b.precision", "b.det"))
    # the innermost rows have too small a covariance; junk among the rest must not stretch it further
    far = _far(rows, now)
    scale = F.least(F.greatest(F.lit(1.0), F.col("limit") / chi2_quantile(keep_share, p)), F.lit(consistency(keep_share, p)))
    near = far.join(small(_quantile(far, keep_share)), ["g", "s"]).filter(F.col("d") <= chi2_quantile(NEAR, p) * scale)
    for _ in range(REWEIGHTS):
        now = _inverted(_moments(near))
        near = _far(rows, now).filter(F.col("d") <= chi2_quantile(NEAR, p))
    scale = F.greatest(F.lit(1.0), F.col("limit") / chi2_quantile(0.5, p))
    return now.join(_quantile(near, 0.5), ["g", "s"]).select("g", "centre", "precision", scale.alias("scale"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", columns: list[str] | None = None,
          min_rows: int = MIN_ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """``columns`` of every row of ``docs``, COUNTS, ``base_failed``, ``distance`` and ``kept``.

    A null, empty or blank text fails the base rules (fewer than 50 words).
    Null languages or sources are groups of their own.  Repeated rows are
    judged each.  ``distance`` is null where the base rules fail or no group is
    large enough.  An empty table gives no rows.  Columns of ``docs`` called
    like the new ones can't be kept.
    """
    mine = {*COUNTS, "base_failed", "distance", "kept"}
    columns = ["doc_id"] if columns is None else [c for c in columns if c not in mine]
    # extra columns ride along in one struct, so no name of theirs meets ours
    src = docs.select(F.struct(*columns).alias("__row"), F.col(lang).cast("string").alias("__lang"),
                      F.col(source).cast("string").alias("__source"), F.col(text).alias("__text"))
    counts = cut(statistics(src, "__text", ["__row", "__lang", "__source"]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = counts.withColumn("base_failed", failed).withColumn("x", vector()).withColumn("g3", F.to_json(F.struct("__lang", "__source"))).withColumn(
        "g2", F.to_json(F.struct("__lang")))
    n3 = named.filter("not base_failed").groupBy("g2", "g3").agg(F.count(F.lit(1)).alias("n3"))
    n3 = n3.withColumn("few", F.col("n3") < min_rows)
    n2 = n3.filter("few").groupBy("g2").agg(F.sum("n3").alias("n2"))
    names = cut(n3.join(n2, "g2", "left").select("g3", F.when(~F.col("few"), F.col("g3")).when(F.col("n2") >= min_rows, F.col("g2"))
                                                .otherwise(F.lit(ALL)).alias("g")))
    named = named.join(small(names), "g3", "left")
    rows = named.filter("not base_failed").select("g", "x")
    if not names.filter(F.col("g") == ALL).isEmpty():
        rows = rows.filter(F.col("g") != ALL).union(rows.select(F.lit(ALL).alias("g"), "x"))
    large = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows).select("g")
    est = cut(estimates(rows.join(small(cut(large)), "g", "left_semi")))
    out = named.join(small(est), "g", "left")
    limit = chi2_quantile(confidence, len(FLOORS))
    d = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    return (out.withColumn("distance", d).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))
            .select("__row.*", *COUNTS, "base_failed", "distance", "kept"))
