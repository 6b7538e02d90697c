"""Page -> ordered token rows, on the JVM.

One alternation regex finds the markup (comments, declarations, elements whose
content is not markup, tags); the text is the gaps between its matches.  Every
character of the page lands in exactly one token, so joining the tokens in
``pos`` order gives the page back byte for byte.

Content model.  Elements whose content is not markup are one match up to their
own end tag, or to the end of the page where it is missing, and are split into
open tag, body and close tag.  The body of title and textarea is text (with
character references), that of the others raw text.  The content of a template
is a document of its own that no one visits: its tokens are found by an ordered
fold over the page's template tags (nested ones count, an unmatched end tag
doesn't, an open template reaches to the end of the page).

``level`` is the number of elements open before a token (a running sum over the
page), so ``(level, pos)`` is breadth-first order on well-nested markup.
The window is partitioned by ``page_id``: a group is one page, whatever its
size, and never grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from babelfold.functions import text as T

MAX_PAGE_BYTES = 50 * 1024 * 1024   # the declared page limit (50 MiB); reported, never enforced

# --- fixed values ----------------------------------------------------------------
HTML_SPACE = r"\t\n\f\r "
# Markup only: comments, script/style blocks, tags, declarations.  Text is
# the gaps between matches, so no pattern
# repeats a group: Java's regex engine recurses on group repetition, and a
# page with many bare '<' would otherwise overflow the task's stack.
# A '>' inside a quoted attribute value does not end a tag; a quote that is
# never closed is an ordinary character.  The runs are possessive: they are
# matched in a loop, not by recursion, however many attributes a tag has.
TAG_REST = r"(?:[^>=]++|=[\t\n\f\r ]*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
# elements whose content is not markup: text only, raw text, and everything after
TEXT_ONLY_TAGS = ("title", "textarea")
RAW_TAGS = ("script", "style", "iframe", "noembed", "noframes", "noscript", "xmp")
REST_OF_PAGE_TAG = "plaintext"
AFTER_NAME = rf"(?:>|[\t\n\f\r /]{TAG_REST})"
_CONTENT = "|".join(
    [rf"{t}{AFTER_NAME}(?s:.*?)(?:</{t}(?:[\t\n\f\r /][^>]*)?>|\z)" for t in (*RAW_TAGS, *TEXT_ONLY_TAGS)]
    + [rf"{REST_OF_PAGE_TAG}{AFTER_NAME}(?s:.*)\z"])
# The alternatives share their first '<', so a character of the text is looked at once.
MARKUP_RE = (
    r"<(?:!--(?:-?>|(?s:.*?)(?:--!?>|\z))"
    rf"|(?i:{_CONTENT})"
    rf"|/?[a-zA-Z]{TAG_REST}"
    r"|/>|(?:[!?]|/[^a-zA-Z>])[^>]*(?:>|\z)"
    r"|/?[a-zA-Z][^>]*\z)"
)
_CONTENT_NAMES = "|".join((*RAW_TAGS, *TEXT_ONLY_TAGS, REST_OF_PAGE_TAG))
CONTENT_OPEN_RE = rf"^(?i:(<(?:{_CONTENT_NAMES}){AFTER_NAME}))"
CONTENT_NAME_RE = rf"^(?i:<({_CONTENT_NAMES}))"
END_TAG_AT_END_RE = r"^(?s:.*)(</[a-zA-Z]+(?:[\t\n\f\r /][^>]*)?>)\z"
TEMPLATE_RE = r"(?i)^</?template(?:>|[\t\n\f\r /])"
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "meta", "param", "source", "track", "wbr",
)
# ----------------------------------------------------------------------------------

TAG_NAME_RE = r"^</?([a-zA-Z][^\t\n\f\r />]*)"

TOKEN_COLUMNS = ["page_id", "pos", "kind", "tag", "level", "raw"]


def _sql_flat_tokens(html: str, max_bytes: int | None = None) -> str:
    """SQL text: gap/markup tokens of a page in order; elements without markup inside in three."""
    t = "m"
    nul = "CAST(NULL AS STRING)"
    mk = lambda raw, k, par: f"named_struct('raw', {raw}, 'k', '{k}', 'parent', {par})"
    # x: the open tag, the name, and the end tag at the match's end if it has the same name
    name = f"lower(regexp_extract({t}, {T.sql_str(CONTENT_NAME_RE)}, 1))"
    end = f"regexp_extract({t}, {T.sql_str(END_TAG_AT_END_RE)}, 1)"
    parts = (f"named_struct('op', regexp_extract({t}, {T.sql_str(CONTENT_OPEN_RE)}, 1), 'parent', {name}, "
             f"'cl', transform(array({end}), e -> CASE WHEN startswith(lower(e), concat('</', {name})) THEN e ELSE '' END)[0])")
    body = f"substring({t}, length(x.op) + 1, length({t}) - length(x.op) - length(x.cl))"
    content = (f"flatten(transform(array({parts}), x -> "
               f"array({mk('x.op', 'markup', 'x.parent')}, {mk(body, 'body', 'x.parent')}, {mk('x.cl', 'markup', 'x.parent')})))")
    markup = (f"CASE WHEN {t} IS NULL THEN array() "
              f"WHEN {t} RLIKE {T.sql_str(CONTENT_OPEN_RE)} THEN {content} "
              f"ELSE array({mk(t, 'markup', nul)}) END")
    pat = T.sql_str(MARKUP_RE)
    # the gaps by a pattern too: split() would compile it anew for every page.  The
    # empty gap that may follow at the page's end falls out with the empty tokens.
    gaps = T.sql_str(rf"(?s:(.*?))(?:{MARKUP_RE}|\z)")
    pairs = (f"zip_with(regexp_extract_all({html}, {gaps}, 1), regexp_extract_all({html}, {pat}, 0), "
             f"(g, {t}) -> concat(array({mk('g', 'gap', nul)}), {markup}))")
    tokens = f"filter(flatten({pairs}), x -> x.raw IS NOT NULL AND x.raw <> '')"
    # NULL and empty pages (and, where a job sets a limit, larger ones) are one
    # untouched 'whole' token, so they flow through the same plan
    whole = f"{html} IS NULL OR {html} = ''" + (f" OR octet_length({html}) > {int(max_bytes)}" if max_bytes else "")
    return f"CASE WHEN {whole} THEN array({mk(html, 'whole', nul)}) ELSE {tokens} END"


def _sql_template_spans(html: str, toks: str) -> str:
    """SQL text: spans (s, e) of token positions strictly inside a page's outermost
    templates, NULL for pages without one.  An ordered fold over the template tags:
    the depth so far, where the open template began, the spans closed so far."""
    marks = (f"filter(transform({toks}, (x, i) -> named_struct('i', i, 'd', CASE WHEN x.k <> 'markup' OR NOT x.raw RLIKE {T.sql_str(TEMPLATE_RE)} "
             f"THEN 0 WHEN startswith(x.raw, '</') THEN -1 ELSE 1 END)), y -> y.d <> 0)")
    state = "named_struct('depth', 0, 'at', -1, 'spans', CAST(array() AS array<struct<s:int,e:int>>))"
    st = lambda depth, at, spans: f"named_struct('depth', {depth}, 'at', {at}, 'spans', {spans})"
    step = (f"CASE WHEN y.d = 1 THEN {st('a.depth + 1', 'CASE WHEN a.depth = 0 THEN y.i ELSE a.at END', 'a.spans')} "
            f"WHEN a.depth = 1 THEN {st('0', '-1', 'array_append(a.spans, named_struct(\'s\', a.at, \'e\', y.i))')} "
            f"WHEN a.depth > 1 THEN {st('a.depth - 1', 'a.at', 'a.spans')} ELSE a END")
    done = "CASE WHEN a.depth > 0 THEN array_append(a.spans, named_struct('s', a.at, 'e', 2147483647)) ELSE a.spans END"
    return f"CASE WHEN {html} RLIKE '(?i)<template' THEN aggregate({marks}, {state}, (a, y) -> {step}, a -> {done}) END"


def tokenize(pages: DataFrame, html_col: str = "html", with_level: bool = True,
             max_bytes: int | None = None) -> DataFrame:
    """``pages(page_id, html)`` -> ``tokens(page_id, pos, kind, tag, level, raw)``.

    kind: open | close | text | rawtext | comment | decl | unvisited | whole (a
    NULL or empty page, kept as one untouched token; with ``max_bytes`` larger
    ones too).  ``rawtext`` is the body of an element without markup or character
    references (``tag`` names it), ``unvisited`` any token inside a template.
    Expects ``pages`` hash-partitioned on ``page_id`` (see
    :func:`partition_pages`) so the window adds no exchange.
    """
    t = pages.select("page_id", F.col(html_col).alias("html"), F.expr(_sql_flat_tokens(f"`{html_col}`", max_bytes)).alias("toks"))
    t = t.select("page_id", "toks", F.expr(_sql_template_spans("html", "toks")).alias("hidden"))
    # every page has a token; the plain form would add a filter on the array, which
    # Spark pushes below its projection, so that each page would be taken apart twice
    t = t.select("page_id", "hidden", F.posexplode_outer("toks").alias("pos", "tok"))
    void = ", ".join(T.sql_str(v) for v in VOID_TAGS)
    text_only = ", ".join(T.sql_str(v) for v in TEXT_ONLY_TAGS)
    t = t.selectExpr(
        "page_id", "pos", "tok.raw AS raw", "tok.parent AS parent",
        f"""CASE WHEN hidden IS NOT NULL AND exists(hidden, h -> pos > h.s AND pos < h.e) THEN 'unvisited'
                 WHEN tok.k = 'body' AND tok.parent IN ({text_only}) THEN 'text'
                 WHEN tok.k = 'body' THEN 'rawtext'
                 WHEN tok.k = 'whole' THEN 'whole'
                 WHEN tok.k = 'gap' THEN 'text'
                 WHEN startswith(tok.raw, '<!--') THEN 'comment'
                 WHEN tok.raw RLIKE '^<(?:[!?]|/[^a-zA-Z])' OR NOT endswith(tok.raw, '>') THEN 'decl'
                 WHEN startswith(tok.raw, '</') THEN 'close'
                 ELSE 'open' END AS kind""",
    )
    t = t.selectExpr(
        "page_id", "pos", "kind", "raw",
        f"""CASE WHEN kind IN ('open', 'close') THEN lower(regexp_extract(raw, {T.sql_str(TAG_NAME_RE)}, 1))
                 WHEN kind = 'rawtext' THEN parent END AS tag""",
    )
    t = t.selectExpr(
        "page_id", "pos", "kind", "tag", "raw",
        f"""CASE WHEN kind = 'open' AND NOT tag IN ({void}) AND NOT endswith(raw, '/>') THEN 1
                 WHEN kind = 'close' AND NOT tag IN ({void}) THEN -1 ELSE 0 END AS delta""",
    )
    if not with_level:  # rendering needs positions only: no window, no sort
        return t.select("page_id", "pos", "kind", "tag", F.lit(None).cast("int").alias("level"), "raw")
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("delta").over(w), F.lit(0)).cast("int")
    return t.select("page_id", "pos", "kind", "tag", level.alias("level"), "raw")


def partition_pages(pages: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """The one shuffle of the page pipeline: hash pages on ``page_id``.

    Every later window, aggregate and join of the page pipeline is keyed on
    ``page_id`` (first), so it reuses this partitioning instead of shuffling
    tokens.  Shuffling the compact page rows is cheaper than shuffling tokens.
    """
    pages = pages.filter(F.col("page_id").isNotNull())  # NULL ids are reported, never tokenised
    if num_partitions:
        return pages.repartition(num_partitions, "page_id")
    return pages.repartition("page_id")


def first_of_each(pages: DataFrame) -> DataFrame:
    """Numbers the rows of a page id (``copy`` from 1, in the order of a hash of the
    page, so that every branch of a plan numbers alike).  Expects the partitioning
    of :func:`partition_pages` and adds no exchange."""
    w = Window.partitionBy("page_id").orderBy(F.xxhash64("html"))
    return pages.withColumn("copy", F.row_number().over(w))
