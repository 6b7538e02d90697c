"""Segments -> numbered request batches.

Batch size follows the reference's rule: ``max(5, n div max(1, c))`` where
``n`` is the page's segment count and ``c`` the number of concurrent batches
(so a page may get more than ``c`` batches).  A fixed ``size`` overrides it.
All windows and groups are per page and reuse the page partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from babelfold.functions import text as T

# --- fixed values -----------------------------------------------------------------
MIN_BATCH_SIZE = 5
DEFAULT_CONCURRENT_BATCHES = 5
DEFAULT_BATCH_SIZE = 25   # declared presets, used only when asked for
LARGE_BATCH_SIZE = 100
SOURCE_LANG = "auto"
DEFAULT_TARGET_LANG = "zh"
# language codes the reference accepts (case-sensitive)
SUPPORTED_LANGUAGES = (
    "zh", "en", "ja", "ko", "fr", "de", "es", "it", "pt", "ru",
    "ar", "hi", "th", "vi", "id", "ms", "tl", "nl", "sv", "da",
    "no", "fi", "pl", "cs", "sk", "hu", "ro", "bg", "hr", "sr",
    "sl", "et", "lv", "lt", "mt", "ga", "cy", "is", "mk", "sq",
)
# -----------------------------------------------------------------------------------


def lang_supported(col: Column) -> Column:
    """Membership in the supported codes (case-sensitive); NULL counts as unsupported."""
    return F.coalesce(col.isin(*SUPPORTED_LANGUAGES), F.lit(False))


def check_lang(lang: str) -> str:
    """Job guard for the target-language parameter."""
    if lang not in SUPPORTED_LANGUAGES:
        raise ValueError(f"unsupported target language: {lang!r}")
    return lang


def batch_size_expr(n: Column, concurrent: int = DEFAULT_CONCURRENT_BATCHES, size: int | None = None) -> Column:
    if size is not None:
        return F.lit(max(1, int(size))).cast("long")
    c = max(1, int(concurrent))
    return F.greatest(F.lit(MIN_BATCH_SIZE).cast("long"), F.floor(n / F.lit(c)).cast("long"))


def plan_batches(segments: DataFrame, concurrent: int = DEFAULT_CONCURRENT_BATCHES,
                 size: int | None = None, group_col: str = "page_id") -> DataFrame:
    """Adds ``n``, ``batch_size`` and ``batch_idx`` to ``(group, seq, text)`` rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group_col))
    out = segments.withColumn("n", n)
    out = out.withColumn("batch_size", batch_size_expr(F.col("n"), concurrent, size))
    return out.withColumn("batch_idx", F.floor(F.col("seq") / F.col("batch_size")).cast("long"))


def marker_line(seq: Column, text: Column, escape_newlines: bool = False) -> Column:
    t = T.fold_ws(text) if escape_newlines else text
    return F.concat(F.lit("["), seq.cast("string"), F.lit("] "), T.trim_ws(t))


def build_payload(planned: DataFrame, escape_newlines: bool = False, group_col: str = "page_id") -> DataFrame:
    """One row per batch: ``[seq] text`` lines joined with newlines, in seq order.

    ``items`` keeps the batch's own ``(seq, text)`` pairs so the translation map
    can be built from the responses alone (no second read of the segments).

    Embedded newlines are kept unless ``escape_newlines`` (then every
    whitespace run in a text becomes one space).
    """
    line = marker_line(F.col("seq"), F.col("text"), escape_newlines)
    g = planned.groupBy(group_col, "batch_idx").agg(
        F.array_sort(F.collect_list(F.struct(F.col("seq"), line.alias("line"), F.col("text")))).alias("lines"),
        F.count(F.lit(1)).alias("n_items"),
        F.min("seq").alias("first_seq"),
        F.max("n").alias("n"),
    )
    return g.select(
        group_col, "batch_idx",
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("payload"),
        "n_items", "first_seq", "n",
        F.transform("lines", lambda x: F.struct(x["seq"].alias("seq"), x["text"].alias("text"))).alias("items"),
    )


def request_json(payload: Column, target_lang: str = DEFAULT_TARGET_LANG,
                 source_lang: str = SOURCE_LANG) -> Column:
    """The service request body; the target language is a real (checked) parameter."""
    check_lang(target_lang)
    return F.to_json(F.struct(payload.alias("text"), F.lit(source_lang).alias("source_lang"),
                              F.lit(target_lang).alias("target_lang")))
