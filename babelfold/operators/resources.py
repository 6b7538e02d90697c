"""Page-level operators of the crawl path: resource stripping and the title.

Both work on tokens and rebuild or read per page; groups are one page each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from babelfold.functions import text as T
from babelfold.operators import segments as S


# --- fixed values: what belongs to each switch ---------------------------------------
IMAGE_TAGS, IMAGE_ATTRS = ("img", "source"), ("src", "srcset")
# ------------------------------------------------------------------------------------
_SP = r"\t\n\f\r "
STRIP_PREFILTER_RE = rf"(?i)[{_SP}/](on[a-z]|style|src|rel)"


def with_resource_pieces(tokens: DataFrame) -> DataFrame:
    """Adds the pieces of the tags that :func:`strip_resources` may change."""
    return S.with_pieces(tokens, f"kind = 'open' AND raw RLIKE {T.sql_str(STRIP_PREFILTER_RE)}")


def strip_resources(tokens: DataFrame, css: bool = True, js: bool = False, images: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Pages ``(page_id, html)`` without the resources whose switch is off.

    ``js``: script elements and ``on...`` attributes; ``css``: style elements,
    stylesheet links and style attributes; ``images``: the sources of images (the
    images stay, with their texts).  Instead of a value a switch may be the name of
    a boolean column of the tokens, listed in ``by`` with any further key.  All else,
    the inside of templates too, stays as it is; a NULL page stays NULL.  Tokens that
    are repeated for several sets of switches should come :func:`with_resource_pieces`:
    their tags are then taken apart once, not once a set.
    """
    on = {k: (v if isinstance(v, str) else str(v).upper()) for k, v in {"css": css, "js": js, "images": images}.items()}
    t = tokens if "a0" in tokens.columns else with_resource_pieces(tokens)
    names = lambda vals: ", ".join(T.sql_str(v) for v in vals)
    sheet = f"exists(a0, a -> a.name = 'rel' AND lower(a.value) RLIKE {T.sql_str(rf'(^|[{_SP}])stylesheet([{_SP}]|$)')})"
    gone = (f"(NOT {on['js']} AND tag = 'script') OR (NOT {on['css']} AND (tag = 'style' OR (tag = 'link' AND kind = 'open' AND {sheet})))")
    drop = (f"(NOT {on['js']} AND startswith(a.name, 'on')) OR (NOT {on['css']} AND a.name = 'style') "
            f"OR (NOT {on['images']} AND tag IN ({names(IMAGE_TAGS)}) AND a.name IN ({names(IMAGE_ATTRS)}))")
    left = f"array_join(transform(filter(a0, a -> NOT coalesce({drop}, false)), a -> a.piece), '')"
    out = F.expr(f"CASE WHEN coalesce({gone}, false) THEN '' WHEN a0 IS NOT NULL THEN {left} ELSE raw END")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", out.alias("o")))), lambda x: x["o"]), "")
    # a NULL page is one token without text
    return t.groupBy("page_id", *by).agg(F.when(F.count("raw") > 0, joined).alias("html"))


def page_title(tokens: DataFrame) -> DataFrame:
    """Text of the first text token that directly follows a ``<title>`` tag."""
    w = Window.partitionBy("page_id").orderBy("pos")
    t = tokens.withColumn("prev_tag", F.lag("tag").over(w)).withColumn("prev_kind", F.lag("kind").over(w))
    t = t.filter((F.col("kind") == "text") & (F.col("prev_kind") == "open") & (F.col("prev_tag") == "title"))
    return t.groupBy("page_id").agg(F.min_by(T.trim_ws(T.decode_entities("raw")), F.col("pos")).alias("title"))
