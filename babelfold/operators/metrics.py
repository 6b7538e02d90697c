"""Metrics: sizes, throughput, grades, durations and the per-page run report.

Ratios use ``try_divide`` (a zero denominator gives NULL instead of failing
under ANSI mode).  Wall-clock numbers cannot be compared with an oracle, so
the timing rules are applied to a millisecond column of any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------
GRADE_BOUNDS_MS = (500, 800, 1000)   # inclusive upper bounds of grades 1..3
GRADE_LABELS = ("excellent", "good", "pass", "slow")
TARGET_MS = 1000                      # met when strictly below
# -------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def perf_grade(ms) -> Column:
    m = _c(ms)
    return (F.when(m <= GRADE_BOUNDS_MS[0], 1).when(m <= GRADE_BOUNDS_MS[1], 2)
            .when(m <= GRADE_BOUNDS_MS[2], 3).otherwise(4))


def grade_label(grade) -> Column:
    g = _c(grade)
    out = F.lit(GRADE_LABELS[-1])
    for i in reversed(range(len(GRADE_LABELS) - 1)):
        out = F.when(g == i + 1, F.lit(GRADE_LABELS[i])).otherwise(out)
    return out


def target_met(ms) -> Column:
    return _c(ms) < TARGET_MS


def format_duration(ms) -> Column:
    """``{n}ms`` below a second, else seconds with three decimals (exact for whole ms)."""
    m = _c(ms)
    secs = F.concat(F.floor(m / 1000).cast("string"), F.lit("."),
                    F.lpad((m % 1000).cast("string"), 3, "0"), F.lit("s"))
    return F.when(m < 1000, F.concat(m.cast("string"), F.lit("ms"))).otherwise(secs)


def throughput_kbps(n_bytes, ms) -> Column:
    """KB per second; NULL when no time elapsed."""
    return F.try_divide(_c(n_bytes) / 1024.0, _c(ms) / 1000.0)


def size_metrics(bytes_in, bytes_out) -> list[Column]:
    bi, bo = _c(bytes_in), _c(bytes_out)
    return [
        bi.alias("bytes_in"), bo.alias("bytes_out"),
        (bi / 1024.0).alias("kb_in"), (bo / 1024.0).alias("kb_out"),
        ((F.try_divide(bo.cast("double"), bi.cast("double")) - 1.0) * 100.0).alias("change_pct"),
    ]


def run_report(spark, counts: dict, ms: int) -> DataFrame:
    """The report of a run (one row) from its counts and its time in milliseconds."""
    fields = ("n_pages", "bytes_in", "bytes_out", "texts_collected", "texts_kept", "n_hits", "n_misses", "n_batches", "n_failed_batches", "n_applied")
    row = spark.range(1).select(*[F.lit(int(counts.get(f) or 0)).cast("long").alias(f) for f in fields], F.lit(int(ms)).cast("long").alias("ms"))
    return row.select(*fields, (F.col("texts_collected") - F.col("texts_kept")).alias("texts_filtered"),
                      *size_metrics("bytes_in", "bytes_out")[2:],
                      hit_rate("n_hits", "n_misses").alias("hit_rate"), "ms", format_duration("ms").alias("duration"),
                      throughput_kbps("bytes_in", "ms").alias("kb_per_s"), perf_grade("ms").alias("grade"), grade_label(perf_grade("ms")).alias("label"),
                      target_met("ms").alias("target_met"))


def hit_rate(hits, misses) -> Column:
    h, m = _c(hits), _c(misses)
    return F.when(h + m > 0, F.try_divide(h.cast("double"), (h + m).cast("double")))


def run_metrics(out_pages: DataFrame, responses: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """One row per page.

    The batch, failure and acceptance counts come from ONE aggregate over the
    responses (each carries its page's segment count ``n``); input/output bytes
    and applied counts come with the translated pages (``bytes_in`` is
    measured on the tokens).  Two page-level inputs, one co-partitioned join;
    the raw pages are not read again.

    With a memory ``split(page_id, hit)`` tells hits from misses (the pipeline
    keeps it as a written table): segments are counted there, since only the
    misses were sent.  Without one every segment is a miss.
    """
    from babelfold.operators.responses import sql_marked_lines, unwrap_response

    r = responses.withColumn("text", unwrap_response(F.col("response")))
    acc = F.expr(f"CASE WHEN error_class IS NULL THEN size(coalesce({sql_marked_lines()}, array())) ELSE 0 END")
    stats = r.groupBy("page_id").agg(
        F.max("n").alias("n_misses"), F.count(F.lit(1)).alias("n_batches"),
        F.count("error_class").alias("n_failed_batches"), F.sum(acc).alias("n_accepted"))
    out = out_pages.select("page_id", "bytes_in", F.octet_length("html").alias("bytes_out"), "n_applied")
    j = out.join(stats, "page_id", "left").withColumn("n_misses", F.coalesce("n_misses", F.lit(0)))
    if split is not None:
        j = j.join(split.groupBy("page_id").agg(F.count_if("hit").alias("n_hits")), "page_id", "left")
    else:
        j = j.withColumn("n_hits", F.lit(0))
    j = j.withColumn("n_segments", F.col("n_misses") + F.coalesce("n_hits", F.lit(0)))
    counts = ["n_segments", "n_hits", "n_misses", "n_batches", "n_failed_batches", "n_accepted", "n_applied"]
    return j.select("page_id", F.col("bytes_in").cast("int").alias("bytes_in"),
                    F.col("bytes_out").cast("int").alias("bytes_out"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                                          for c in counts])


def job_totals(per_page: DataFrame) -> DataFrame:
    """Roll the per-page run metrics up to one job row (a single global aggregate)."""
    counts = [c for c in ("n_hits", "n_misses") if c in per_page.columns] + ["bytes_in", "bytes_out", "n_segments", "n_batches", "n_failed_batches", "n_accepted", "n_applied"]
    return per_page.agg(F.count(F.lit(1)).alias("n_pages"), *[F.sum(c).alias(c) for c in counts])
