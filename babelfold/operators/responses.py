"""Response handling: unwrap JSON, parse ``[n] text`` markers, scatter.

Rules kept from the reference:

* JSON object -> value of the FIRST PRESENT key among data/text/result; if
  that value is not a string the raw body is used (no fall-through).
* each line is trimmed and must read ``[digits] rest`` with a non-empty rest;
  numbers that overflow are dropped;
* an index at or beyond the page's segment count is dropped; the last write
  wins in (batch, line) order; repeats still count as accepted lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelfold.functions import text as T

# --- fixed values ------------------------------------------------------------------
RESPONSE_KEYS = ("data", "text", "result")
MARKER_RE = rf"(?s)^\[([0-9]+)\]{T.WS}*(.*)\z"
# ------------------------------------------------------------------------------------

JSON_OBJECT_RE = rf"(?s)^{T.WS}*\{{.*\}}{T.WS}*\z"


def unwrap_response(body) -> Column:
    b = F.col(body) if isinstance(body, str) else body
    v = F.try_parse_json(b)
    is_obj = b.rlike(JSON_OBJECT_RE) & v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    keys = F.json_object_keys(b)
    out = b
    # evaluated last-to-first so that the first present key decides
    for k in reversed(RESPONSE_KEYS):
        is_str = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING"
        val = F.when(is_str, F.get_json_object(b, f"$.{k}")).otherwise(b)
        out = F.when(F.array_contains(keys, k), val).otherwise(out)
    return F.when(is_obj, out).otherwise(b)


def parse_markers(responses: DataFrame, text_col: str = "text", group_col: str = "page_id") -> DataFrame:
    """``(group, batch_idx, [n,] text)`` -> ``marked(group, batch_idx, [n,] line_no, seq, text)``."""
    keep = [c for c in (group_col, "batch_idx", "n") if c in responses.columns]
    lines = responses.select(*keep, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    ln = T.trim_ws(F.col("line"))
    idx = F.regexp_extract(ln, MARKER_RE, 1).try_cast("long")
    rest = T.trim_ws(F.regexp_extract(ln, MARKER_RE, 2))
    out = lines.select(*keep, F.col("line_no").cast("long").alias("line_no"),
                       F.when(ln.rlike(MARKER_RE), idx).alias("seq"), rest.alias("text"))
    return out.filter(F.col("seq").isNotNull() & (F.col("text") != ""))


def with_counts(marked: DataFrame, segments: DataFrame, group_col: str = "page_id") -> DataFrame:
    """Attach ``n`` (segments per group) when the responses did not carry it."""
    if "n" in marked.columns:
        return marked
    counts = segments.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    return marked.join(counts, group_col)


def accepted(marked: DataFrame) -> DataFrame:
    """Lines whose index is inside the group (``seq < n``)."""
    return marked.filter(F.col("seq") < F.col("n"))


def scatter(marked: DataFrame, group_col: str = "page_id") -> DataFrame:
    """Last write wins per (group, seq) in (batch, line) order.

    ``marked`` must carry ``n`` (see :func:`with_counts`); indices at or beyond
    it are dropped.  Returns ``translations(group, seq, translation)``.
    """
    order = F.col("batch_idx") * F.lit(1 << 32) + F.col("line_no")
    return accepted(marked).groupBy(group_col, "seq").agg(F.max_by("text", order).alias("translation"))


def success_rate(marked: DataFrame, batches: DataFrame, group_col: str = "page_id") -> DataFrame:
    """accepted lines / n * 100 (can exceed 100) and distinct coverage, per group.

    ``batches`` supplies every group with its ``n`` (groups whose batches all
    failed still appear, with rate 0).
    """
    counts = batches.groupBy(group_col).agg(F.max("n").alias("n"))
    acc = accepted(marked).groupBy(group_col).agg(F.count(F.lit(1)).alias("n_accepted"),
                                                  F.count_distinct("seq").alias("n_covered"))
    j = counts.join(acc, group_col, "left").fillna(0, ["n_accepted", "n_covered"])
    return j.select(
        group_col, "n", "n_accepted", "n_covered",
        (F.col("n_accepted") * 100.0 / F.col("n")).alias("success_rate"),
        (F.col("n_covered") * 100.0 / F.col("n")).alias("covered_rate"),
    )


def failed_batches(responses: DataFrame) -> DataFrame:
    return (responses.filter(F.col("error_class").isNotNull())
            .groupBy("error_class").agg(F.count(F.lit(1)).alias("n_batches")))


def sql_marked_lines(text: str = "text", batch: str = "batch_idx", n: str = "n") -> str:
    """SQL text: accepted marker lines of a response as array<struct<seq, tr, ord>>.

    Each line is trimmed once; the marker pattern runs only on lines that start
    with ``[``.
    """
    m = T.sql_str(MARKER_RE)
    trimmed = f"transform(split({text}, '\\n', -1), l -> {T.sql_trim('l')})"
    parsed = (f"transform({trimmed}, (l, i) -> CASE WHEN startswith(l, '[') AND l RLIKE {m} THEN named_struct("
              f"'seq', try_cast(regexp_extract(l, {m}, 1) AS BIGINT), "
              f"'tr', {T.sql_trim(f'regexp_extract(l, {m}, 2)')}, "
              f"'ord', {batch} * 4294967296 + i) END)")
    return f"filter({parsed}, x -> x IS NOT NULL AND x.seq IS NOT NULL AND x.tr <> '' AND x.seq < {n})"


def translation_map_from_responses(responses: DataFrame) -> DataFrame:
    """``(page_id, seq, text, translation)`` straight from the responses.

    Every response row carries its batch's ``(seq, text)`` items; its accepted
    marker lines are parsed in place.  One aggregate per ``(page_id, seq)``
    then joins the two by grouping (last write wins in (batch, line) order),
    so the segments are not read a second time.  The group key has
    ``page_id`` first and reuses the page partitioning.
    """
    # items of failed batches still count (another batch may write to their seq)
    ok = responses.select("page_id", "batch_idx", "n", "items", "error_class",
                          unwrap_response(F.col("response")).alias("text"))
    items = "transform(items, x -> named_struct('seq', x.seq, 'text', x.text, 'tr', CAST(NULL AS STRING), " \
            "'ord', CAST(NULL AS BIGINT)))"
    lines = f"transform({sql_marked_lines()}, x -> named_struct('seq', x.seq, 'text', CAST(NULL AS STRING), " \
            "'tr', x.tr, 'ord', x.ord))"
    lines = f"CASE WHEN error_class IS NULL THEN coalesce({lines}, array()) ELSE array() END"
    e = ok.select("page_id", F.explode(F.expr(f"concat({items}, {lines})")).alias("r"))
    g = e.groupBy("page_id", F.col("r.seq").alias("seq")).agg(
        F.max("r.text").alias("text"), F.max(F.struct("r.ord", "r.tr")).alias("w"))
    return g.select("page_id", "seq", "text", F.col("w.tr").alias("translation"))
