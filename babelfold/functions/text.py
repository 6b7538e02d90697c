"""String rules shared by every operator, as native Column expressions.

Lengths are UTF-8 bytes, trimming uses the Unicode White_Space set, and every
regular expression sticks to the subset that Java regex and RE2 read the same
way (explicit classes instead of ``\\s``, no look-around, no back-references),
so that the SQL oracle can use the very same patterns.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's rules) -------------------------
# Unicode White_Space, the set used by trim and by whitespace splitting:
# U+0009-000D, U+0020, U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029,
# U+202F, U+205F, U+3000.  Java regex names it \p{IsWhite_Space} (one type
# check per char); RE2, used by the SQL oracle, gets the same set spelled out.
WS_CHARS_EXPLICIT = (
    r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_CHARS = r"\p{IsWhite_Space}"
# ASCII punctuation: ! " # $ % & ' ( ) * + , - . / : ; < = > ? @ [ \ ] ^ _ ` { | } ~
PUNCT_CHARS = r"!-/:-@\[-`{-~"
# Attribute names the reference translates.
TRANSLATABLE_ATTRS = ("title", "alt", "placeholder")
# Tags whose attributes are never rewritten when translations are applied.
NO_ATTR_APPLY_TAGS = ("script", "style", "noscript")
# Words / prefixes that mark a script string as code, not prose.
CODE_PREFIXES = ("http", "www.")
CODE_MARKERS = ("function", "var ")
# Size window for script strings (bytes, exclusive) and their word limit.
JS_MIN_BYTES, JS_MAX_BYTES, JS_MAX_WORDS = 2, 200, 10
# ------------------------------------------------------------------------------

WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"
NOT_WS_PUNCT = f"[^{WS_CHARS}{PUNCT_CHARS}]"
NOT_WS_PUNCT_DIGIT = f"[^{WS_CHARS}{PUNCT_CHARS}0-9]"
# what is left of a text without the white space around it, found in one pass from its start
TRIMMED_RE = f"(?s)^{WS}*+(.*{NOT_WS})?"
WS_RUN_RE = f"{WS}+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_ws(col) -> Column:
    """Unicode trim (SQL ``trim`` only strips ASCII spaces)."""
    return F.regexp_extract(_c(col), TRIMMED_RE, 1)


def byte_len(col) -> Column:
    return F.octet_length(_c(col))


def word_count(col) -> Column:
    """Number of maximal non-whitespace runs (0 for an empty string)."""
    return F.size(F.regexp_extract_all(_c(col), F.lit(f"{NOT_WS}+"), 0))


def has_word_char(col) -> Column:
    """True when some character is neither whitespace nor ASCII punctuation."""
    return _c(col).rlike(NOT_WS_PUNCT)


def is_text_node_kept(trimmed) -> Column:
    """Text-node rule: more than one byte and not only whitespace/punctuation."""
    t = _c(trimmed)
    return (byte_len(t) > 1) & has_word_char(t)


def is_attr_kept(trimmed) -> Column:
    """Attribute rule: more than one byte (punctuation-only values are kept)."""
    t = _c(trimmed)
    return (byte_len(t) > 1) & t.rlike(NOT_WS)


def is_translatable(trimmed) -> Column:
    """Script-string rule, applied to already trimmed text."""
    t = _c(trimmed)
    n = byte_len(t)
    cond = (n > JS_MIN_BYTES) & (n < JS_MAX_BYTES) & t.rlike(NOT_WS_PUNCT_DIGIT)
    for p in CODE_PREFIXES:
        cond = cond & ~t.startswith(p)
    for m in CODE_MARKERS:
        cond = cond & ~t.contains(m)
    return cond & (word_count(t) <= JS_MAX_WORDS)


def fold_ws(col) -> Column:
    """Collapse every whitespace run (newlines included) to one space."""
    return F.regexp_replace(_c(col), F.lit(WS_RUN_RE), F.lit(" "))


# --- character references ------------------------------------------------------
# All names of HTML5 come from the table of Python's standard library, built
# here and not listed: names with ';', and the older ones that also count
# without it.  A reference is the longest name that the text after '&' starts
# with, so a name without ';' can end inside a word ("&notit" is "¬it"); inside
# attribute values such a name doesn't count before '=', a letter or a digit.
ENTITY_TABLE: dict[str, str] = {k[:-1]: v for k, v in sorted(html.entities.html5.items()) if k.endswith(";")}
LEGACY_NAMES: list[str] = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
# --- fixed values: code points 128-159 mean Windows-1252 characters (five have none)
C1_REMAP: dict[int, int] = {128 + i: ord(c) for i in range(32) if (c := bytes([128 + i]).decode("cp1252", "ignore"))}
# ------------------------------------------------------------------------------
_PAIR_SEP, _KV_SEP = "\x02", "\x01"


def decode_entities(name: str) -> Column:
    """The text of column ``name`` with its character references decoded, natively."""
    return F.expr(sql_decode(f"`{name}`"))


def escape_text(col) -> Column:
    """HTML serialisation of text content."""
    c = _c(col)
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("\u00a0"), F.lit("&nbsp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def escape_attr(col) -> Column:
    """HTML serialisation of a double-quoted attribute value."""
    c = _c(col)
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("\u00a0"), F.lit("&nbsp;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


# --- the same rules as Spark SQL text --------------------------------------------------
# Heavy expressions are built as SQL text and parsed once with ``F.expr``: one
# driver->JVM call instead of hundreds of Column calls; the plan is identical.

def explicit_ws(pattern: str) -> str:
    """The same pattern with the White_Space property spelled out (for RE2)."""
    return pattern.replace(WS_CHARS, WS_CHARS_EXPLICIT)


def sql_str(s: str) -> str:
    """Spark SQL string literal for ``s`` (backslash, quote and non-ASCII escaped)."""
    out = []
    for ch in s:
        o = ord(ch)
        if ch == "\\":
            out.append("\\\\")
        elif ch == "'":
            out.append("\\'")
        elif 0x20 <= o < 0x7F:
            out.append(ch)
        elif o <= 0xFFFF:
            out.append(f"\\u{o:04x}")
        else:
            o -= 0x10000
            out.append(f"\\u{0xD800 + (o >> 10):04x}\\u{0xDC00 + (o & 0x3FF):04x}")
    return "'" + "".join(out) + "'"


def sql_trim(x: str) -> str:
    return f"regexp_extract({x}, {sql_str(TRIMMED_RE)}, 1)"


def sql_word_count(x: str) -> str:
    return f"size(regexp_extract_all({x}, {sql_str(NOT_WS + '+')}, 0))"


def sql_text_kept(x: str) -> str:
    return f"(octet_length({x}) > 1 AND {x} RLIKE {sql_str(NOT_WS_PUNCT)})"


def sql_attr_kept(x: str) -> str:
    return f"(octet_length({x}) > 1 AND {x} RLIKE {sql_str(NOT_WS)})"


def sql_translatable(x: str) -> str:
    parts = [f"octet_length({x}) > {JS_MIN_BYTES}", f"octet_length({x}) < {JS_MAX_BYTES}",
             f"{x} RLIKE {sql_str(NOT_WS_PUNCT_DIGIT)}"]
    parts += [f"NOT startswith({x}, {sql_str(p)})" for p in CODE_PREFIXES]
    parts += [f"NOT contains({x}, {sql_str(m)})" for m in CODE_MARKERS]
    parts.append(f"{sql_word_count(x)} <= {JS_MAX_WORDS}")
    return "(" + " AND ".join(parts) + ")"


def sql_cp_to_str(cp: str) -> str:
    b = lambda v: f"lpad(hex({v}), 2, '0')"
    hx = (f"CASE WHEN {cp} < 128 THEN {b(cp)} "
          f"WHEN {cp} < 2048 THEN concat({b(f'192 + shiftright({cp}, 6)')}, {b(f'128 + {cp} % 64')}) "
          f"WHEN {cp} < 65536 THEN concat({b(f'224 + shiftright({cp}, 12)')}, {b(f'128 + shiftright({cp}, 6) % 64')}, "
          f"{b(f'128 + {cp} % 64')}) "
          f"ELSE concat({b(f'240 + shiftright({cp}, 18)')}, {b(f'128 + shiftright({cp}, 12) % 64')}, "
          f"{b(f'128 + shiftright({cp}, 6) % 64')}, {b(f'128 + {cp} % 64')}) END")
    return (f"CASE WHEN {cp} IS NULL OR {cp} = 0 OR ({cp} >= 55296 AND {cp} <= 57343) OR {cp} > 1114111 "
            f"THEN {sql_str(chr(0xFFFD))} ELSE decode(unhex({hx}), 'UTF-8') END")


def sql_entity(name: str) -> str:
    """Text of an entity name (NULL if there is none).  Maps are scanned one entry after the
    other, so the table is split by the first letter, and the commonest names come first."""
    common = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(ENTITY_TABLE[k])}" for k in ("amp", "nbsp", "lt", "gt", "quot", "apos"))
    by_first: dict[str, list[str]] = {}
    for k, v in ENTITY_TABLE.items():
        by_first.setdefault(k[0], []).append(f"{k}{_KV_SEP}{v}")
    maps = [f"str_to_map({sql_str(_PAIR_SEP.join(by_first.get(chr(c), ['?'])))}, {sql_str(_PAIR_SEP)}, {sql_str(_KV_SEP)})"
            for c in range(ord("A"), ord("z") + 1)]
    return f"(CASE {name} {common} ELSE try_element_at(try_element_at(array({', '.join(maps)}), ascii({name}) - 64), {name}) END)"


def sql_decode(x: str, var: str = "ep", attr: bool = False) -> str:
    """SQL for ``x`` with its character references decoded; ``attr`` for attribute values.

    Splits on ``&`` and rewrites each piece that starts with a reference; rows
    without ``&`` skip the work.  ``var`` names the inner lambda variable.  Each
    piece first becomes its decoded text and the length it stands for, so that
    every table is looked up once.
    """
    p, e = var, f"{var}_e"
    digits, hexes = f"regexp_extract({p}, '^#0*([0-9]*)', 1)", f"regexp_extract({p}, '^#[xX]0*([0-9a-fA-F]*)', 1)"
    cp = (f"CASE WHEN {p} RLIKE '^#[0-9]' AND length({digits}) <= 7 THEN coalesce(try_cast({digits} AS INT), 0) "
          f"WHEN {p} RLIKE '^#[xX][0-9a-fA-F]' AND length({hexes}) <= 6 THEN coalesce(CAST(conv({hexes}, 16, 10) AS INT), 0) ELSE 0 END")
    remap = " ".join(f"WHEN {k} THEN {v}" for k, v in C1_REMAP.items())
    numeric = f"regexp_extract({p}, '^(#(?:[0-9]+|[xX][0-9a-fA-F]+);?)', 1)"
    name = f"regexp_extract({p}, '^([A-Za-z][A-Za-z0-9]*);', 1)"
    legacy = f"regexp_extract({p}, {sql_str('^(' + '|'.join(LEGACY_NAMES) + ')')}, 1)"
    # steps: (reference, its code point), (reference, its text)
    number = (f"transform(array({cp}), {e} -> transform(array(CASE {e} {remap} ELSE {e} END), {e}c -> {sql_cp_to_str(f'{e}c')})[0])[0]")
    old = f"{legacy}"
    if attr:  # an old name counts only where no letter, digit or '=' follows
        old = f"CASE WHEN {p} RLIKE {sql_str('^(?:' + '|'.join(LEGACY_NAMES) + ')(?:[^=A-Za-z0-9]|\\z)')} THEN {legacy} ELSE '' END"
    named = (f"transform(array(struct({name} AS n, {sql_entity(name)} AS v)), {e} -> CASE WHEN {e}.v IS NOT NULL "
             f"THEN concat({e}.v, substring({p}, length({e}.n) + 2)) "
             f"ELSE transform(array({old}), {e}o -> CASE WHEN {e}o <> '' THEN concat({sql_entity(f'{e}o')}, substring({p}, length({e}o) + 1)) "
             f"ELSE concat('&', {p}) END)[0] END)[0]")
    piece = (f"CASE WHEN {p} RLIKE '^#(?:[0-9]|[xX][0-9a-fA-F])' THEN concat({number}, substring({p}, length({numeric}) + 1)) "
             f"WHEN {p} RLIKE '^[A-Za-z]' THEN {named} ELSE concat('&', {p}) END")
    parts = f"split({x}, '&', -1)"
    return (f"(CASE WHEN instr({x}, '&') > 0 THEN concat(element_at({parts}, 1), "
            f"array_join(transform(slice({parts}, 2, size({parts})), {p} -> {piece}), '')) ELSE {x} END)")


def sql_escape_text(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '&', '&amp;'), {sql_str(chr(160))}, '&nbsp;'), '<', '&lt;'), "
            f"'>', '&gt;')")


def sql_escape_attr(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), {sql_str(chr(160))}, '&nbsp;'), '\"', '&quot;')"
