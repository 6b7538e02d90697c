"""Applying translations and rendering pages.

The translation map is keyed on ``(page_id, text)``.  Text nodes (any parent,
script and style bodies included) whose trimmed content is a key are replaced
whole; ``title``/``alt``/``placeholder`` values outside script/style/noscript
are replaced in place.  Untouched tokens are emitted verbatim, so a page with
nothing to apply comes back byte for byte.

Physical shape: tokens become "pieces" (a tag that may carry a translatable
attribute is split into its attributes, every other token is one piece), ONE
left join with the map on ``(page_id, key)`` decides every replacement, and
ONE aggregate per page glues the pieces back together.  Both are keyed on
``page_id`` first (page partitioning reused); a page is size-bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelfold.functions import text as T
from babelfold.operators import segments as S

_SP = r"\t\n\f\r "
APPLY_ATTR_PREFILTER_RE = rf"(?i)[{_SP}/](title|alt|placeholder)[{_SP}]*="


def translation_map(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """(page_id, text, translation) for segments with a non-empty translation."""
    # both sides are hash-partitioned on page_id: a per-partition hash join needs
    # no exchange and no sort (a broadcast would only add a job)
    j = segments.select("page_id", "seq", "text").join(translations.hint("shuffle_hash"), ["page_id", "seq"])
    return j.filter(F.col("translation") != "").select("page_id", "text", "translation")


def sql_text_key(kind: str = "kind", raw: str = "raw") -> str:
    """Lookup key of a text token: decoded+trimmed text, or trimmed raw body."""
    return (f"CASE WHEN {kind} = 'text' THEN {T.sql_trim(T.sql_decode(raw))} "
            f"WHEN {kind} = 'rawtext' THEN {T.sql_trim(raw)} END")


def pieces(tokens: DataFrame) -> DataFrame:
    """``(page_id, pos, kind, i, piece, key, pkind)``: the unit of rendering.

    A tag that may carry a translatable attribute (outside script/style/
    noscript) is split into its attribute pieces; every other token is one piece.
    """
    no_apply = ", ".join(T.sql_str(t) for t in T.NO_ATTR_APPLY_TAGS)
    cond = f"kind = 'open' AND NOT tag IN ({no_apply}) AND raw RLIKE {T.sql_str(APPLY_ATTR_PREFILTER_RE)}"
    t = S.with_pieces(tokens, cond)
    names = ", ".join(T.sql_str(n) for n in T.TRANSLATABLE_ATTRS)
    attr_arr = (f"transform(a0, a -> named_struct('i', a.i, 'piece', a.piece, 'key', "
                f"CASE WHEN a.name IN ({names}) AND {S.sql_first('a0', 'a')} "
                f"THEN {T.sql_trim(T.sql_decode('a.value', attr=True))} END, 'pkind', 'attr'))")
    one = f"array(named_struct('i', 0, 'piece', raw, 'key', {sql_text_key()}, 'pkind', kind))"
    arr = f"CASE WHEN a0 IS NOT NULL THEN {attr_arr} ELSE {one} END"
    p = t.select("page_id", "pos", "kind", F.explode(F.expr(arr)).alias("p"))
    return p.select("page_id", "pos", "kind", "p.i", "p.piece", "p.key", "p.pkind")


def applied_pieces(tokens: DataFrame, tmap: DataFrame) -> DataFrame:
    """pieces + ``out`` (rendered piece) and ``applied`` flag."""
    m = tmap.select("page_id", F.col("text").alias("key"), "translation")
    j = pieces(tokens).join(m.hint("shuffle_hash"), ["page_id", "key"], "left")
    out = F.expr(
        f"""CASE WHEN translation IS NULL THEN piece
                 WHEN pkind = 'text' THEN {T.sql_escape_text('translation')}
                 WHEN pkind = 'rawtext' THEN translation
                 WHEN pkind = 'attr' THEN concat(regexp_extract(piece, {T.sql_str(f"^([{_SP}/]+)")}, 1),
                      regexp_extract(piece, {T.sql_str(S.ATTR_PIECE_RE)}, 1), '="',
                      {T.sql_escape_attr('translation')}, '"')
                 ELSE piece END""")
    return j.select("page_id", "pos", "i", "kind", "pkind", "key", "piece", out.alias("out"),
                    F.col("translation").isNotNull().alias("applied"))


def render(applied: DataFrame) -> DataFrame:
    """Rebuild each page from its pieces in ``(pos, i)`` order (one page per group).

    A 'whole' page (NULL, empty or oversized) is its single untouched piece.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "i", "out"))),
                                      lambda x: x["out"]), "")
    is_whole = F.col("pkind") == "whole"
    whole = F.count_if(is_whole) > 0
    return applied.groupBy("page_id").agg(
        F.when(whole, F.max(F.when(is_whole, F.col("piece")))).otherwise(joined).alias("html"),
        F.count_if(F.col("applied")).alias("n_applied"),
        # input size from the pieces themselves (they cover every byte of the page)
        F.when(whole, F.max(F.when(is_whole, F.octet_length("piece"))))
        .otherwise(F.sum(F.octet_length("piece"))).cast("long").alias("bytes_in"),
    )


def applied_count(applied: DataFrame) -> DataFrame:
    return applied.groupBy("page_id").agg(
        F.count_if(F.col("applied") & (F.col("pkind") != "attr")).alias("n_text_applied"),
        F.count_if(F.col("applied") & (F.col("pkind") == "attr")).alias("n_attr_applied"),
        F.count_if(F.col("applied")).alias("n_applied"),
    )


def missing_report(tokens: DataFrame, tmap: DataFrame) -> DataFrame:
    """Text nodes that pass the text rule but got no translation."""
    t = tokens.filter(F.col("kind") == "text").select(
        "page_id", "pos", F.expr(T.sql_trim(T.sql_decode("raw"))).alias("text"))
    t = t.filter(F.expr(T.sql_text_kept("text")))
    return t.join(tmap.select("page_id", "text"), ["page_id", "text"], "left_anti")


def unapplied_report(tokens: DataFrame, tmap: DataFrame) -> DataFrame:
    """Translations that land nowhere (e.g. strings found inside script code)."""
    keys = pieces(tokens).select("page_id", F.col("key").alias("text")).filter(F.col("text").isNotNull())
    return tmap.join(keys, ["page_id", "text"], "left_anti")


def passthrough(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """Pages with nothing rendered (oversized, empty) come back unchanged."""
    r = rendered.select("page_id", F.col("html").alias("html_out"), "n_applied")
    j = pages.join(r, "page_id", "left")
    return j.select(
        "page_id", F.coalesce(F.col("html_out"), F.col("html")).alias("html"),
        F.coalesce(F.col("n_applied"), F.lit(0)).alias("n_applied"),
    )
