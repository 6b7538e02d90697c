"""Extraction: tokens -> translatable strings (segments).

All candidate kinds come out of ONE pass over the tokens (an array of
candidate structs per token, exploded once), then one first-seen aggregate
per ``(page_id, text)`` and one numbering window per page.  Both are keyed on
``page_id`` first and reuse the page partitioning: no shuffle of tokens.

Visiting order is breadth-first: ``ord = (level, pos, phase, a, b, c)``.
An element's attribute strings and its script strings are emitted when the
element is visited; text children one level deeper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from babelfold.functions import text as T

# --- fixed values: extraction patterns (WS stands for Unicode White_Space) ------
JS_STRING_RE = r"""['"`]([^'"`]{3,})['"`]"""
JSON_TEXT_RE = rf'"text":{T.WS}*"([^"]{{3,}})"'
JSON_KEY_RE = rf'"([^"]{{3,}})"{T.WS}*:'
JSON_KV_RE = rf'"([A-Za-z][^"]*)":{T.WS}*"([^"]{{3,}})"'
JSON_KV_KEYS = ("text", "title", "name", "description")
IFRAME_SRC_MARK = "data:text/html;"
IFRAME_TEXT_RE = r">([^<>]{3,})<"
# possessive: matched in a loop, however many words a phrase has
IFRAME_PHRASE_RE = rf"[A-Z][a-z]++(?:{T.WS}++[A-Z]?[a-z]++)*+"
IFRAME_PHRASE_MIN_BYTES, IFRAME_PHRASE_MAX_WORDS, IFRAME_TEXT_MIN_BYTES = 3, 6, 2
# Strict standard Base64: full quanta, canonical padding bits.
STRICT_B64_RE = r"^[A-Za-z0-9+/]*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?\z"
# ----------------------------------------------------------------------------------

_SP = r"\t\n\f\r "
# Covers an open tag completely: head, each attribute with its separator, or one char.
TAG_PIECE_RE = (
    rf"^<[a-zA-Z][^{_SP}/>]*"
    rf"|[{_SP}/]+[^{_SP}/>\"'=]+(?:[{_SP}]*=[{_SP}]*(?:\"[^\"]*\"|'[^']*'|[^{_SP}>]+))?"
    r"|(?s:.)"
)
ATTR_PIECE_RE = rf"^[{_SP}/]+([^{_SP}/>\"'=]+)"
# value patterns are anchored at the name (names hold no '='), one per quoting form
_NAME_EQ = rf"^[{_SP}/]+[^{_SP}/>\"'=]+[{_SP}]*=[{_SP}]*"
ATTR_VALUE_RES = (
    _NAME_EQ + r'"([^"]*)"\z',
    _NAME_EQ + r"'([^']*)'\z",
    _NAME_EQ + rf"([^{_SP}>\"'][^{_SP}>]*)\z",
)
ATTR_PREFILTER_RE = rf"(?i)[{_SP}/](title|alt|placeholder|src)[{_SP}]*="

SEGMENT_KINDS = ("text", "attr", "js_string", "json_text", "json_key", "json_kv",
                 "iframe_text", "iframe_phrase")

_CAND_TYPE = ("array<struct<text:string,kind:string,attr:string,o_level:int,o_pos:int,"
              "o_phase:int,o_a:int,o_b:int,o_c:int>>")
_CAND_FIELDS = ["text", "kind", "attr", "o_level", "o_pos", "o_phase", "o_a", "o_b", "o_c"]


# --- SQL text builders (one F.expr per heavy expression) ------------------------------

def sql_pieces(raw: str) -> str:
    """``array<struct<i, name, value, piece>>``: an open tag split into pieces."""
    name = (f"CASE WHEN p RLIKE {T.sql_str(ATTR_PIECE_RE)} "
            f"THEN lower(regexp_extract(p, {T.sql_str(ATTR_PIECE_RE)}, 1)) END")
    value = "concat(" + ", ".join(f"regexp_extract(p, {T.sql_str(r)}, 1)" for r in ATTR_VALUE_RES) + ")"
    return (f"transform(regexp_extract_all({raw}, {T.sql_str(TAG_PIECE_RE)}, 0), "
            f"(p, i) -> named_struct('i', i, 'name', {name}, 'value', {value}, 'piece', p))")


def sql_first(arr: str, a: str) -> str:
    """The first attribute of its name in the tag (later repeats are ignored)."""
    return f"coalesce(array_position({arr}.name, {a}.name) = {a}.i + 1, false)"


def with_pieces(tokens: DataFrame, cond_sql: str, out: str = "a0") -> DataFrame:
    """Adds the piece table of every token matching ``cond_sql`` (NULL elsewhere)."""
    return tokens.withColumn(out, F.expr(f"CASE WHEN {cond_sql} THEN {sql_pieces('raw')} END"))


def _sql_cand(text, kind, attr, lvl, pos, phase, a, b, c) -> str:
    return (f"named_struct('text', {text}, 'kind', '{kind}', 'attr', CAST({attr} AS STRING), "
            f"'o_level', CAST({lvl} AS INT), 'o_pos', CAST({pos} AS INT), 'o_phase', {phase}, "
            f"'o_a', CAST({a} AS INT), 'o_b', CAST({b} AS INT), 'o_c', CAST({c} AS INT))")


def _sql_matches(src, pattern, group, kind, lvl, pos, phase, a, keep) -> str:
    cands = (f"transform(regexp_extract_all({src}, {T.sql_str(pattern)}, {group}), "
             f"(m, j) -> {_sql_cand(T.sql_trim('m'), kind, 'NULL', lvl, pos, phase, a, 'j', 0)})")
    return f"filter({cands}, c -> {keep('c.text')})"


def _sql_script_candidates() -> str:
    el, ep = "level - 1", "pos - 1"  # strings belong to the <script> element itself
    p1 = _sql_matches("raw", JS_STRING_RE, 1, "js_string", el, ep, 1, 1, T.sql_translatable)
    p2 = _sql_matches("raw", JSON_TEXT_RE, 1, "json_text", el, ep, 1, 2, T.sql_translatable)
    p3 = _sql_matches("raw", JSON_KEY_RE, 1, "json_key", el, ep, 1, 3, T.sql_translatable)
    keys = ", ".join(T.sql_str(k) for k in JSON_KV_KEYS)
    kv = (f"zip_with(regexp_extract_all(raw, {T.sql_str(JSON_KV_RE)}, 1), "
          f"regexp_extract_all(raw, {T.sql_str(JSON_KV_RE)}, 2), (k, v) -> named_struct('k', k, 'v', v))")
    p4 = (f"transform(filter(transform({kv}, (x, j) -> named_struct('k', x.k, 'c', "
          f"{_sql_cand(T.sql_trim('x.v'), 'json_kv', 'NULL', el, ep, 1, 4, 'j', 0)})), "
          f"y -> y.k IN ({keys}) AND {T.sql_translatable('y.c.text')}), y -> y.c)")
    return f"concat({p1}, {p2}, {p3}, {p4})"


def sql_iframe_html(arr: str) -> str:
    """Decoded HTML of a ``data:text/html;`` iframe source, NULL if none/invalid."""
    src = f"try_element_at(filter({arr}, s -> s.name = 'src' AND {sql_first(arr, 's')}), 1)"
    v = T.sql_trim(T.sql_decode(f"{src}.value", "fp", attr=True))
    b64 = (f"CASE WHEN instr({v}, {T.sql_str(IFRAME_SRC_MARK)}) > 0 AND instr({v}, ',') > 0 "
           f"THEN substring({v}, instr({v}, ',') + 1) END")
    return (f"CASE WHEN {b64} RLIKE {T.sql_str(STRICT_B64_RE)} AND length({b64}) % 4 = 0 "
            f"THEN try_validate_utf8(CAST(try_to_binary({b64}, 'base64') AS STRING)) END")


def sql_iframe_src_i(arr: str) -> str:
    return f"try_element_at(filter({arr}, s -> s.name = 'src' AND {sql_first(arr, 's')}), 1).i"


def _sql_attr_candidates(iframe_mode: str) -> str:
    names = ", ".join(T.sql_str(n) for n in T.TRANSLATABLE_ATTRS)
    kept = f"filter(a0, a -> a.name IN ({names}) AND {sql_first('a0', 'a')})"
    cand = _sql_cand(T.sql_trim(T.sql_decode("a.value", attr=True)), "attr", "a.name", "level", "pos", 0, "a.i", 0, 0)
    cands = f"filter(transform({kept}, a -> {cand}), c -> {T.sql_attr_kept('c.text')})"
    if iframe_mode != "repaired":
        return cands
    h, si = sql_iframe_html("a0"), sql_iframe_src_i("a0")
    txt = _sql_matches(h, IFRAME_TEXT_RE, 1, "iframe_text", "level", "pos", 0, si,
                       lambda t: f"(octet_length({t}) > {IFRAME_TEXT_MIN_BYTES} AND {t} RLIKE {T.sql_str(T.NOT_WS_PUNCT)})")
    phr = _sql_matches(h, IFRAME_PHRASE_RE, 0, "iframe_phrase", "level", "pos", 0, si,
                       lambda t: f"(octet_length({t}) > {IFRAME_PHRASE_MIN_BYTES} AND "
                                 f"{T.sql_word_count(t)} <= {IFRAME_PHRASE_MAX_WORDS})")
    # iframe strings sort after the src attribute itself: (a = src piece, b = pass, c = match)
    shift = lambda arr, k: f"transform({arr}, c -> named_struct('text', c.text, 'kind', c.kind, 'attr', c.attr, " \
        f"'o_level', c.o_level, 'o_pos', c.o_pos, 'o_phase', c.o_phase, 'o_a', c.o_a, 'o_b', {k}, 'o_c', c.o_b))"  # noqa: E731
    frame = (f"CASE WHEN tag = 'iframe' THEN concat(coalesce({shift(txt, 1)}, array()), "
             f"coalesce({shift(phr, 2)}, array())) END")
    return f"concat({cands}, coalesce({frame}, CAST(array() AS {_CAND_TYPE})))"


def candidates(tokens: DataFrame, iframe_mode: str = "off") -> DataFrame:
    """Every extracted string with its visiting-order key, before dedupe (one pass)."""
    t = with_pieces(tokens, f"kind = 'open' AND raw RLIKE {T.sql_str(ATTR_PREFILTER_RE)}")
    text_c = _sql_cand(T.sql_trim(T.sql_decode("raw")), "text", "NULL", "level", "pos", 0, 0, 0, 0)
    raw_c = _sql_cand(T.sql_trim("raw"), "text", "NULL", "level", "pos", 0, 0, 0, 0)
    arr = (f"CASE WHEN kind = 'text' THEN filter(array({text_c}), c -> {T.sql_text_kept('c.text')}) "
           f"WHEN kind = 'rawtext' AND tag <> 'script' THEN filter(array({raw_c}), c -> {T.sql_text_kept('c.text')}) "
           f"WHEN kind = 'rawtext' AND tag = 'script' THEN {_sql_script_candidates()} "
           f"WHEN a0 IS NOT NULL THEN {_sql_attr_candidates(iframe_mode)} END")
    c = t.select("page_id", "tag", F.explode(F.expr(f"CAST(({arr}) AS {_CAND_TYPE})")).alias("c"))
    return c.select("page_id", *[F.col(f"c.{f}").alias(f) for f in _CAND_FIELDS], "tag")


def extract_segments(tokens: DataFrame, iframe_mode: str = "off", observed: dict | None = None) -> DataFrame:
    """``tokens`` -> ``segments(page_id, seq, kind, tag, attr, text)``.

    First occurrence of each exact trimmed text wins across all kinds;
    ``seq`` is dense from 0 per page in visiting order.
    """
    cand = candidates(tokens, iframe_mode)
    if observed:
        cand = cand.observe(observed["candidates"], F.count(F.lit(1)).alias("texts_collected"))
    ord_ = F.struct("o_level", "o_pos", "o_phase", "o_a", "o_b", "o_c", "kind", "tag", "attr")
    first = cand.groupBy("page_id", "text").agg(F.min(ord_).alias("f"))
    w = Window.partitionBy("page_id").orderBy("f")
    return first.select(
        "page_id",
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        F.col("f.kind").alias("kind"),
        F.when(F.col("f.kind") == "text", None).otherwise(F.col("f.tag")).alias("tag"),
        F.col("f.attr").alias("attr"),
        "text",
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n_segments"))
