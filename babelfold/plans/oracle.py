"""DuckDB SQL twins of the Spark operators (the correctness oracle).

Each helper returns SQL text.  Nothing is imported from the operators: the rules
(patterns, names, bounds) are written out here once more, in RE2's syntax, and
the logic in SQL, so that a change of an operator's rule shows as a difference.
"""

from __future__ import annotations

import html.entities

# --- fixed values: the rules, for RE2 ---------------------------------------------
WS_CHARS = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS, NOT_WS = f"[{WS_CHARS}]", f"[^{WS_CHARS}]"
ASCII_PUNCT = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
NOT_WS_PUNCT, NOT_WS_PUNCT_DIGIT = f"[^{WS_CHARS}{ASCII_PUNCT}]", f"[^{WS_CHARS}{ASCII_PUNCT}0-9]"
TRIM_RE, WS_RUN_RE = f"^{WS}+|{WS}+\\z", f"{WS}+"
JS_MIN_BYTES, JS_MAX_BYTES, JS_MAX_WORDS = 2, 200, 10
CODE_PREFIXES, CODE_MARKERS = ("http", "www."), ("function", "var ")
TRANSLATABLE_ATTRS, NO_ATTR_APPLY_TAGS = ("title", "alt", "placeholder"), ("script", "style", "noscript")
JS_STRING_RE = r"""['"`]([^'"`]{3,})['"`]"""
JSON_TEXT_RE = rf'"text":{WS}*"([^"]{{3,}})"'
JSON_KEY_RE = rf'"([^"]{{3,}})"{WS}*:'
JSON_KV_RE = rf'"([A-Za-z][^"]*)":{WS}*"([^"]{{3,}})"'
JSON_KV_KEYS = ("text", "title", "name", "description")
IFRAME_SRC_MARK, IFRAME_TEXT_RE = "data:text/html;", ">([^<>]{3,})<"
IFRAME_PHRASE_RE = rf"[A-Z][a-z]+(?:{WS}+[A-Z]?[a-z]+)*"
IFRAME_PHRASE_MIN_BYTES, IFRAME_PHRASE_MAX_WORDS, IFRAME_TEXT_MIN_BYTES = 3, 6, 2
STRICT_B64_RE = "^[A-Za-z0-9+/]*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?\\z"
SP = r"\t\n\f\r "  # white space between attributes
TAG_PIECE_RE = (rf"^<[a-zA-Z][^{SP}/>]*|[{SP}/]+[^{SP}/>\"'=]+(?:[{SP}]*=[{SP}]*(?:\"[^\"]*\"|'[^']*'|[^{SP}>]+))?|(?s:.)")
ATTR_PIECE_RE = rf"^[{SP}/]+([^{SP}/>\"'=]+)"
ATTR_VALUE_RES = tuple(rf"^[{SP}/]+[^{SP}/>\"'=]+[{SP}]*=[{SP}]*" + v for v in
                       (r'"([^"]*)"\z', r"'([^']*)'\z", rf"([^{SP}>\"'][^{SP}>]*)\z"))
ATTR_PREFILTER_RE = rf"(?i)[{SP}/](?:title|alt|placeholder|src)[{SP}]*="
APPLY_ATTR_PREFILTER_RE = rf"(?i)[{SP}/](?:title|alt|placeholder)[{SP}]*="
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr")
TAG_NAME_RE = r"^</?([a-zA-Z][^\t\n\f\r />]*)"
RESPONSE_KEYS = ("data", "text", "result")
JSON_OBJECT_RE, MARKER_RE = rf"(?s)^{WS}*\{{.*\}}{WS}*\z", rf"(?s)^\[([0-9]+)\]{WS}*(.*)\z"
MIN_BATCH_SIZE, CONCURRENT_BATCHES = 5, 5
# -----------------------------------------------------------------------------------


def q(s: str) -> str:
    """DuckDB literal."""
    return "'" + s.replace("'", "''") + "'"


def inlist(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


# --- scalar helpers ------------------------------------------------------------------

def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(TRIM_RE)}, '', 'g')"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(NOT_WS + '+')}))"


def text_kept(x: str) -> str:
    return f"(strlen({x}) > 1 AND regexp_matches({x}, {q(NOT_WS_PUNCT)}))"


def attr_kept(x: str) -> str:
    return f"(strlen({x}) > 1 AND regexp_matches({x}, {q(NOT_WS)}))"


def translatable(x: str) -> str:
    parts = [f"strlen({x}) > {JS_MIN_BYTES}", f"strlen({x}) < {JS_MAX_BYTES}",
             f"regexp_matches({x}, {q(NOT_WS_PUNCT_DIGIT)})"]
    parts += [f"NOT starts_with({x}, {q(p)})" for p in CODE_PREFIXES]
    parts += [f"NOT contains({x}, {q(m)})" for m in CODE_MARKERS]
    parts.append(f"{word_count(x)} <= {JS_MAX_WORDS}")
    return "(" + " AND ".join(parts) + ")"


def fold_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(WS_RUN_RE)}, ' ', 'g')"


def _entity_map() -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in html.entities.html5.items()) + "}"


def cp_to_str(cp: str) -> str:
    return (f"(CASE WHEN {cp} IS NULL OR {cp} = 0 OR ({cp} BETWEEN 55296 AND 57343) OR {cp} > 1114111 "
            f"THEN chr(65533) ELSE chr({cp}) END)")


_OLD = sorted((k for k in html.entities.html5 if k[-1] != ";"), key=len, reverse=True)  # names without ';'
_CP1252 = {i: ord(bytes([i]).decode("cp1252")) for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}


def decode(x: str, attr: bool = False) -> str:
    """Character references: the longest known name after '&', or a number."""
    cp = (f"CASE WHEN r.num[2] IN ('x', 'X') THEN CASE WHEN length(ltrim(r.num[3:], '0')) > 6 THEN 0 ELSE CAST('0x0' || ltrim(r.num[3:], '0') AS INTEGER) END "
          f"WHEN length(ltrim(r.num[2:], '0')) > 7 THEN 0 ELSE CAST('0' || ltrim(r.num[2:], '0') AS INTEGER) END")
    remap = "CASE c " + " ".join(f"WHEN {k} THEN {v}" for k, v in _CP1252.items()) + " ELSE c END"
    number = f"list_transform([{cp}], lambda c: {cp_to_str('(' + remap + ')')})[1]"
    old = q("^(?:" + "|".join(_OLD) + ")")
    old_ref = f"regexp_extract(p, {old})"
    if attr:
        old_ref = f"CASE WHEN regexp_matches(substr(p, length({old_ref}) + 1), '^[=A-Za-z0-9]') THEN '' ELSE {old_ref} END"
    refs = (f"struct_pack(num := regexp_extract(p, '^#(?:[0-9]+|[xX][0-9a-fA-F]+)'), "
            f"full := regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;'), old := {old_ref})")
    names = _entity_map()
    piece = (f"list_transform([{refs}], lambda r: CASE WHEN r.num <> '' THEN {number} || regexp_replace(substr(p, length(r.num) + 1), '^;', '') "
             f"ELSE list_transform([struct_pack(m := {names})], lambda t: "
             f"CASE WHEN t.m[r.full] IS NOT NULL THEN t.m[r.full] || substr(p, length(r.full) + 1) "
             f"WHEN r.old <> '' THEN t.m[r.old] || substr(p, length(r.old) + 1) ELSE '&' || p END)[1] END)[1]")
    parts = f"string_split({x}, '&')"
    return (f"(CASE WHEN contains({x}, '&') THEN ({parts})[1] || "
            f"array_to_string(list_transform(({parts})[2:], lambda p: {piece}), '') ELSE {x} END)")


def escape_text(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;')"


def escape_attr(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), chr(160), '&nbsp;'), '\"', '&quot;')"


def unwrap(b: str) -> str:
    inner = b
    for k in reversed(RESPONSE_KEYS):
        val = f"CASE WHEN json_type({b}, {q('$.' + k)}) = 'VARCHAR' THEN json_extract_string({b}, {q('$.' + k)}) ELSE {b} END"
        inner = f"CASE WHEN list_contains(json_keys({b}), {q(k)}) THEN {val} ELSE {inner} END"
    is_obj = f"(regexp_matches({b}, {q(JSON_OBJECT_RE)}) AND json_valid({b}) AND json_type({b}) = 'OBJECT')"
    return f"(CASE WHEN {is_obj} THEN ({inner}) ELSE {b} END)"


def prefix_translate(payload: str, lang: str = "zh") -> str:
    return (f"array_to_string(list_transform(string_split({payload}, chr(10)), "
            f"lambda l: regexp_replace(l, {q(r'^(\[[0-9]+\]) ')}, {q(chr(92) + '1 ' + lang + ':')})), chr(10))")


# --- URLs ----------------------------------------------------------------------------

URL_RE2 = r"(?is)^https?:[/\\]*([^/\\?#]*)([^?#]*)"
PATH_ENCODED_RE2 = r"(?s)[^\x00-\x20\x22#<>?`{}\x7F-\x{10FFFF}]+|[\x00-\x20\x22#<>?`{}\x7F-\x{10FFFF}]+"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` under a name, worked out once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def url_path(raw: str) -> str:
    dots, two = "('.', '%2e', '..', '.%2e', '%2e.', '%2e%2e')", "('..', '.%2e', '%2e.', '%2e%2e')"
    segs = f"string_split(replace(regexp_replace({raw}, {q(r'^[/\\]')}, ''), chr(92), '/'), '/')"
    fold = (f"list_reduce(list_concat([''], v), lambda a, s: CASE WHEN lower(s) IN {two} THEN regexp_replace(a, '/[^/]*$', '') "
            f"WHEN lower(s) IN {dots} THEN a ELSE a || '/' || s END)")
    whole = _let("v", segs, f"{fold} || CASE WHEN lower(v[-1]) IN {dots} THEN '/' ELSE '' END")
    whole = _let("w", whole, "CASE WHEN starts_with(w, '/') THEN w ELSE '/' || w END")
    return (f"array_to_string(list_transform(regexp_extract_all({whole}, {q(PATH_ENCODED_RE2)}), lambda r: "
            f"CASE WHEN regexp_matches(r, {q(PATH_ENCODED_RE2.split('|')[0].replace('(?s)', '^'))}) THEN r ELSE url_encode(r) END), '')")


def _ipv6(t: str) -> str:
    groups = lambda x: f"list_filter(string_split({x}, ':'), lambda g: g <> '')"
    full = (f"CASE WHEN contains({t}, '::') THEN list_concat({groups(f'split_part({t}, {q('::')}, 1)')}, "
            f"list_transform(range(0, greatest(0, 8 - len({groups(t)}))), lambda k: '0'), {groups(f'split_part({t}, {q('::')}, 2)')}) "
            f"ELSE string_split({t}, ':') END")
    plain = "':' || array_to_string(list_transform(u, lambda g: regexp_replace(lower(g), '^0+([0-9a-f])', '\\1')), ':') || ':'"
    short = "CASE " + " ".join(
        f"WHEN contains(z, '{':' + '0:' * n}') THEN substr(z, 1, strpos(z, '{':' + '0:' * n}') - 1) || '::' || substr(z, strpos(z, '{':' + '0:' * n}') + {2 * n + 1})"
        for n in range(8, 1, -1)) + " ELSE z END"
    short = _let("z", plain, _let("y", short, "regexp_replace(regexp_replace(y, '^:([^:])', '\\1'), '([^:]):$', '\\1')"))
    ok = "len(u) = 8 AND len(list_filter(u, lambda g: NOT regexp_matches(g, '^[0-9A-Fa-f]{1,4}$'))) = 0"
    return (f"CASE WHEN len(string_split({t}, '::')) <= 2 THEN "
            + _let("u", full, f"CASE WHEN {ok} THEN '[' || {short} || ']' END") + " END")


def cte_urls(src: str, url: str, keys: str) -> str:
    """CTEs ur_a .. urls(<keys>, <url>, host, path); host and path are NULL where it is no http(s) URL."""
    return f"""
ur_a AS (SELECT {keys}, {url}, translate(regexp_replace({url}, {q(r'^[\x00-\x20]+|[\x00-\x20]+$')}, '', 'g'), chr(9) || chr(10) || chr(13), '') AS c FROM {src}),
ur_b AS (SELECT *, regexp_replace(regexp_extract(c, {q(URL_RE2)}, 1), '(?s)^.*@', '') AS place, regexp_extract(c, {q(URL_RE2)}, 2) AS raw FROM ur_a),
ur_c AS (SELECT *, regexp_extract(place, {q(r'^\[([0-9A-Fa-f:]+)\](?::[0-9]*)?$')}, 1) AS v6, regexp_extract(place, {q(r'(?s)^([^:\[\]]+)(?::[0-9]*)?$')}, 1) AS name,
           ltrim(regexp_extract(place, ':([0-9]*)$', 1), '0') AS port FROM ur_b),
ur_d AS (SELECT *, CASE WHEN v6 <> '' THEN {_ipv6('v6')} WHEN name <> '' THEN lower(url_decode(name)) END AS h FROM ur_c),
urls AS (
  SELECT {keys}, {url}, CASE WHEN ok THEN h END AS host, CASE WHEN ok THEN {url_path('raw')} END AS path FROM (
    SELECT *, coalesce(regexp_matches(c, {q(URL_RE2)}) AND h <> '' AND (v6 <> '' OR NOT regexp_matches(h, {q(r'[\x00-\x20#%/:<>?@\[\\\]^|\x7F]')}))
      AND length(CASE WHEN v6 <> '' AND suffix(place, ']') THEN '' ELSE port END) <= 5
      AND coalesce(TRY_CAST(CASE WHEN v6 <> '' AND suffix(place, ']') THEN '' ELSE port END AS INTEGER), 0) <= 65535, false) AS ok FROM ur_d))"""


# --- table fragments (CTE bodies) ------------------------------------------------------

REST_RE2 = r"(?:[^>=]|=[\t\n\f\r ]*(?:\"[^\"]*\"|'[^']*')?)*>"
AFTER_RE2 = r"(?:>|[\t\n\f\r /]" + REST_RE2 + ")"
_ENDED = "|".join(n + AFTER_RE2 + r"(?s:.*?)(?:</" + n + r"(?:[\t\n\f\r /][^>]*)?>|\z)" for n in
                  ("iframe", "noembed", "noframes", "noscript", "script", "style", "textarea", "title", "xmp"))
MARKUP_RE2 = (r"<!--(?:>|->|(?s:.*?)(?:-->|--!>|\z))|(?i:<(?:" + _ENDED + "|plaintext" + AFTER_RE2 + r"(?s:.*)\z))|</?[a-zA-Z]" + REST_RE2
              + r"|</>|<(?:[!?]|/[^a-zA-Z>])[^>]*(?:>|\z)|</?[a-zA-Z][^>]*\z")
CONTENT_RE2 = "(?i:^(<(iframe|noembed|noframes|noscript|plaintext|script|style|textarea|title|xmp)" + AFTER_RE2 + "))"


def cte_tokens(src: str) -> str:
    """CTEs tk_w .. tokens from a relation ``src(page_id, html)``."""
    st = lambda raw, sub, k, par: (f"struct_pack(raw := {raw}, sub := {sub}, k := {k}, "  # noqa: E731
                                   f"parent := {par})")
    void, nul = inlist(VOID_TAGS), "CAST(NULL AS VARCHAR)"
    end_re = q(r"^(?s:.*)(</[a-zA-Z]+(?:[\t\n\f\r /][^>]*)?>)\z")
    template = q(r"(?i)^</?template(?:>|[\t\n\f\r /])")
    return f"""
tk_w AS (SELECT page_id, html, html IS NULL OR html = '' AS whole
         FROM {src} WHERE page_id IS NOT NULL),
tk_a AS (SELECT page_id, regexp_split_to_array(html, {q(MARKUP_RE2)}) AS gs,
                 regexp_extract_all(html, {q(MARKUP_RE2)}) AS ms FROM tk_w WHERE NOT whole),
tk_g AS (SELECT page_id, unnest(gs) AS t, generate_subscripts(gs, 1) AS mno FROM tk_a),
tk_m AS (SELECT page_id, unnest(ms) AS t, generate_subscripts(ms, 1) AS mno FROM tk_a),
tk_b AS (
  SELECT page_id, mno, t, op, parent, CASE WHEN starts_with(lower(cl), '</' || parent) THEN cl ELSE '' END AS cl FROM (
    SELECT page_id, mno, t, regexp_extract(t, {q(CONTENT_RE2)}, 1) AS op, lower(regexp_extract(t, {q(CONTENT_RE2)}, 2)) AS parent,
           regexp_extract(t, {end_re}, 1) AS cl FROM tk_m WHERE regexp_matches(t, {q(CONTENT_RE2)}))),
tk_s AS (
  SELECT page_id, 0 AS mno, {st('html', 0, "'whole'", nul)} AS s FROM tk_w WHERE whole
  UNION ALL
  SELECT page_id, mno, {st('t', 0, "'gap'", nul)} AS s FROM tk_g
  UNION ALL
  SELECT page_id, mno, {st('t', 1, "'markup'", nul)} AS s FROM tk_m WHERE NOT regexp_matches(t, {q(CONTENT_RE2)})
  UNION ALL
  SELECT page_id, mno, unnest([{st('op', 1, "'markup'", 'parent')}, {st('cl', 3, "'markup'", 'parent')},
    {st('substr(t, length(op) + 1, length(t) - length(op) - length(cl))', 2, "'body'", 'parent')}]) AS s FROM tk_b),
tk_p AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY mno, s.sub) - 1 AS INTEGER) AS pos,
         s.raw AS raw, s.k AS k, s.parent AS parent
  FROM tk_s WHERE s.k = 'whole' OR s.raw <> ''),
-- template depth: a running sum that an unmatched end tag can't take below zero
tk_d AS (
  SELECT *, CASE WHEN k <> 'markup' OR NOT regexp_matches(raw, {template}) THEN 0 WHEN starts_with(raw, '</') THEN -1 ELSE 1 END AS d FROM tk_p),
tk_e AS (SELECT *, sum(d) OVER (PARTITION BY page_id ORDER BY pos) AS s FROM tk_d),
tk_f AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY pos)) AS depth FROM tk_e),
tk_h AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY page_id ORDER BY pos), 0) AS before FROM tk_f),
tk_k AS (
  SELECT page_id, pos, raw, parent,
    -- a template's own tags are visited: the one that opens it and the one that closes it
    CASE WHEN before > 0 AND NOT (d = -1 AND depth = 0) THEN 'unvisited'
         WHEN k = 'body' AND parent IN ('title', 'textarea') THEN 'text'
         WHEN k = 'body' THEN 'rawtext'
         WHEN k = 'whole' THEN 'whole'
         WHEN k = 'gap' THEN 'text'
         WHEN starts_with(raw, '<!--') THEN 'comment'
         WHEN regexp_matches(raw, '^<(?:[!?]|/[^a-zA-Z])') OR NOT suffix(raw, '>') THEN 'decl'
         WHEN starts_with(raw, '</') THEN 'close'
         ELSE 'open' END AS kind
  FROM tk_h),
tk_t AS (
  SELECT page_id, pos, kind, raw,
    CASE WHEN kind IN ('open', 'close') THEN lower(regexp_extract(raw, {q(TAG_NAME_RE)}, 1))
         WHEN kind = 'rawtext' THEN parent END AS tag
  FROM tk_k),
tokens AS (
  SELECT page_id, pos, kind, tag,
    CAST(coalesce(sum(CASE WHEN kind = 'open' AND tag NOT IN {void} AND NOT suffix(raw, '/>') THEN 1
                           WHEN kind = 'close' AND tag NOT IN {void} THEN -1 ELSE 0 END)
         OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER)
      AS level,
    raw
  FROM tk_t)"""


def attr_list(raw: str) -> str:
    """SQL list of struct(i, name, value, piece, first) for a tag, like segments.attr_table."""
    pieces = f"regexp_extract_all({raw}, {q(TAG_PIECE_RE)})"
    name_of = lambda p: (f"CASE WHEN regexp_matches({p}, {q(ATTR_PIECE_RE)}) "  # noqa: E731
                         f"THEN lower(regexp_extract({p}, {q(ATTR_PIECE_RE)}, 1)) END")
    names = f"list_transform({pieces}, lambda p: {name_of('p')})"
    value = " || ".join(f"regexp_extract(p, {q(r)}, 1)" for r in ATTR_VALUE_RES)
    return (f"list_transform({pieces}, lambda p, k: struct_pack(i := k - 1, name := ({names})[k], "
            f"value := {value}, piece := p, first := coalesce(list_position({names}, ({names})[k]) = k, false)))")


def _cand_sel(text, kind, attr, lvl, pos, phase, a, b, c, tag="tag") -> str:
    return (f"page_id, {text} AS text, {q(kind)} AS kind, CAST({attr} AS VARCHAR) AS attr, {tag} AS tag, "
            f"CAST({lvl} AS INTEGER) AS o_level, CAST({pos} AS INTEGER) AS o_pos, {phase} AS o_phase, "
            f"CAST({a} AS INTEGER) AS o_a, CAST({b} AS INTEGER) AS o_b, CAST({c} AS INTEGER) AS o_c")


def _js_pass(pattern: str, group: int, kind: str, pass_no: int) -> str:
    return f"""
  SELECT {_cand_sel('text', kind, 'NULL', 'level - 1', 'pos - 1', 1, pass_no, 'j', 0)} FROM (
    SELECT page_id, tag, level, pos, {trim_ws('m')} AS text, j FROM (
      SELECT page_id, tag, level, pos, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS j FROM (
        SELECT page_id, tag, level, pos, regexp_extract_all(raw, {q(pattern)}, {group}) AS ms
        FROM tokens WHERE kind = 'rawtext' AND tag = 'script')))
  WHERE {translatable('text')}"""


def cte_segments(iframe_mode: str = "off") -> str:
    """CTEs cand .. segments from ``tokens``."""
    kv = f"""
  SELECT {_cand_sel('text', 'json_kv', 'NULL', 'level - 1', 'pos - 1', 1, 4, 'j', 0)} FROM (
    SELECT page_id, tag, level, pos, k, {trim_ws('v')} AS text, j FROM (
      SELECT page_id, tag, level, pos, unnest(ks) AS k, unnest(vs) AS v, generate_subscripts(ks, 1) - 1 AS j FROM (
        SELECT page_id, tag, level, pos, regexp_extract_all(raw, {q(JSON_KV_RE)}, 1) AS ks,
               regexp_extract_all(raw, {q(JSON_KV_RE)}, 2) AS vs
        FROM tokens WHERE kind = 'rawtext' AND tag = 'script')))
  WHERE k IN {inlist(JSON_KV_KEYS)} AND {translatable('text')}"""
    attrs = f"""
  SELECT {_cand_sel('text', 'attr', 'name', 'level', 'pos', 0, 'i', 0, 0)} FROM (
    SELECT page_id, tag, level, pos, a.i AS i, a.name AS name, {trim_ws(decode('a.value', attr=True))} AS text FROM (
      SELECT page_id, tag, level, pos, unnest({attr_list('raw')}) AS a
      FROM tokens WHERE kind = 'open' AND regexp_matches(raw, {q(ATTR_PREFILTER_RE)}))
    WHERE a.name IN {inlist(TRANSLATABLE_ATTRS)} AND a.first)
  WHERE {attr_kept('text')}"""
    iframe = ""
    if iframe_mode == "repaired":
        iframe = f"""
  UNION ALL
  SELECT {_cand_sel('text', 'iframe_text', 'NULL', 'level', 'pos', 0, 'src_i', 1, 'j')} FROM (
    SELECT page_id, tag, level, pos, src_i, {trim_ws('m')} AS text, j FROM (
      SELECT page_id, tag, level, pos, src_i, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS j FROM (
        SELECT page_id, tag, level, pos, src_i, regexp_extract_all(h, {q(IFRAME_TEXT_RE)}, 1) AS ms FROM iframes)))
  WHERE strlen(text) > {IFRAME_TEXT_MIN_BYTES} AND regexp_matches(text, {q(NOT_WS_PUNCT)})
  UNION ALL
  SELECT {_cand_sel('text', 'iframe_phrase', 'NULL', 'level', 'pos', 0, 'src_i', 2, 'j')} FROM (
    SELECT page_id, tag, level, pos, src_i, {trim_ws('m')} AS text, j FROM (
      SELECT page_id, tag, level, pos, src_i, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS j FROM (
        SELECT page_id, tag, level, pos, src_i, regexp_extract_all(h, {q(IFRAME_PHRASE_RE)}, 0) AS ms FROM iframes)))
  WHERE strlen(text) > {IFRAME_PHRASE_MIN_BYTES} AND {word_count('text')} <= {IFRAME_PHRASE_MAX_WORDS}"""
    pre = cte_iframes() + "," if iframe_mode == "repaired" else ""
    return f"""{pre}
cand AS (
  SELECT {_cand_sel(trim_ws(decode('raw')), 'text', 'NULL', 'level', 'pos', 0, 0, 0, 0)}
  FROM tokens WHERE kind = 'text' AND {text_kept(trim_ws(decode('raw')))}
  UNION ALL
  SELECT {_cand_sel(trim_ws('raw'), 'text', 'NULL', 'level', 'pos', 0, 0, 0, 0)}
  FROM tokens WHERE kind = 'rawtext' AND tag <> 'script' AND {text_kept(trim_ws('raw'))}
  UNION ALL {_js_pass(JS_STRING_RE, 1, 'js_string', 1)}
  UNION ALL {_js_pass(JSON_TEXT_RE, 1, 'json_text', 2)}
  UNION ALL {_js_pass(JSON_KEY_RE, 1, 'json_key', 3)}
  UNION ALL {kv}
  UNION ALL {attrs}{iframe}),
seg_f AS (
  SELECT page_id, text, min(struct_pack(o_level := o_level, o_pos := o_pos, o_phase := o_phase, o_a := o_a,
         o_b := o_b, o_c := o_c, kind := kind, tag := tag, attr := attr)) AS f
  FROM cand GROUP BY page_id, text),
segments AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY f) - 1 AS BIGINT) AS seq,
         f.kind AS kind, CASE WHEN f.kind = 'text' THEN NULL ELSE f.tag END AS tag, f.attr AS attr, text
  FROM seg_f)"""


def cte_iframes() -> str:
    """``iframes(page_id, tag, level, pos, src_i, h)``: decoded data-URI iframe HTML."""
    v = trim_ws(decode("a.value", attr=True))
    return f"""
ifr_a AS (
  SELECT page_id, tag, level, pos, a.i AS src_i, {v} AS v FROM (
    SELECT page_id, tag, level, pos, unnest({attr_list('raw')}) AS a
    FROM tokens WHERE kind = 'open' AND tag = 'iframe')
  WHERE a.name = 'src' AND a.first),
ifr_b AS (
  SELECT *, CASE WHEN contains(v, {q(IFRAME_SRC_MARK)}) AND strpos(v, ',') > 0
                 THEN substr(v, strpos(v, ',') + 1) END AS b64 FROM ifr_a),
iframes AS (
  SELECT page_id, tag, level, pos, src_i,
    CASE WHEN regexp_matches(b64, {q(STRICT_B64_RE)}) AND length(b64) % 4 = 0
         THEN try(decode(from_base64(b64))) END AS h
  FROM ifr_b)"""


def cte_batches(concurrent: int = CONCURRENT_BATCHES, size: int | None = None,
                escape_newlines: bool = False, src: str = "segments", group: str = "page_id") -> str:
    bs = str(max(1, int(size))) if size is not None else f"greatest({MIN_BATCH_SIZE}, n // {max(1, int(concurrent))})"
    t = fold_ws("text") if escape_newlines else "text"
    return f"""
planned AS (
  SELECT {group}, seq, text, n, CAST({bs} AS BIGINT) AS batch_size, CAST(seq // ({bs}) AS BIGINT) AS batch_idx
  FROM (SELECT {group}, seq, text, count(*) OVER (PARTITION BY {group}) AS n FROM {src})),
batches AS (
  SELECT {group}, batch_idx,
         string_agg('[' || CAST(seq AS VARCHAR) || '] ' || {trim_ws(t)}, chr(10) ORDER BY seq) AS payload,
         count(*) AS n_items, min(seq) AS first_seq, max(n) AS n
  FROM planned GROUP BY {group}, batch_idx)"""


def cte_after_batches(lang: str = "zh") -> str:
    """responses .. translations with the prefix mock translator."""
    return f"""
responses AS (
  SELECT page_id, batch_idx, n, {prefix_translate('payload', lang)} AS response,
         CAST(NULL AS VARCHAR) AS error_class, CAST(NULL AS VARCHAR) AS error_message FROM batches),
ok_resp AS (SELECT page_id, batch_idx, n, {unwrap('response')} AS text FROM responses WHERE error_class IS NULL),
{cte_marked('ok_resp')},
translations AS (
  SELECT page_id, seq, arg_max(text, batch_idx * 4294967296 + line_no) AS translation
  FROM marked WHERE seq < n GROUP BY page_id, seq)"""


def cte_marked(src: str, group: str = "page_id", extra: str = ", n") -> str:
    return f"""
mk_l AS (
  SELECT {group}, batch_idx{extra}, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no
  FROM (SELECT {group}, batch_idx{extra}, string_split(text, chr(10)) AS ls FROM {src})),
mk_t AS (SELECT {group}, batch_idx{extra}, line_no, {trim_ws('line')} AS ln FROM mk_l),
marked AS (
  SELECT * FROM (
    SELECT {group}, batch_idx{extra}, line_no, TRY_CAST(regexp_extract(ln, {q(MARKER_RE)}, 1) AS BIGINT) AS seq,
           {trim_ws(f"regexp_extract(ln, {q(MARKER_RE)}, 2)")} AS text
    FROM mk_t WHERE regexp_matches(ln, {q(MARKER_RE)}))
  WHERE seq IS NOT NULL AND text <> '')"""


def cte_apply() -> str:
    """tmap, pieces, applied, rendered from tokens/segments/translations."""
    attr_tag = (f"kind = 'open' AND tag NOT IN {inlist(NO_ATTR_APPLY_TAGS)} "
                f"AND regexp_matches(raw, {q(APPLY_ATTR_PREFILTER_RE)})")
    tkey = f"CASE WHEN kind = 'text' THEN {trim_ws(decode('raw'))} WHEN kind = 'rawtext' THEN {trim_ws('raw')} END"
    akey = f"CASE WHEN a.name IN {inlist(TRANSLATABLE_ATTRS)} AND a.first THEN {trim_ws(decode('a.value', attr=True))} END"
    sep = f"regexp_extract(piece, {q(rf'^([{SP}/]+)')}, 1)"
    name = f"regexp_extract(piece, {q(ATTR_PIECE_RE)}, 1)"
    return f"""
tmap AS (
  SELECT s.page_id, s.text, t.translation FROM segments s JOIN translations t ON s.page_id = t.page_id AND s.seq = t.seq
  WHERE t.translation <> ''),
pieces AS (
  SELECT page_id, pos, kind, CAST(a.i AS INTEGER) AS i, a.piece AS piece, {akey} AS key, 'attr' AS pkind
  FROM (SELECT page_id, pos, kind, unnest({attr_list('raw')}) AS a FROM tokens WHERE {attr_tag})
  UNION ALL
  SELECT page_id, pos, kind, 0 AS i, raw AS piece, {tkey} AS key, kind AS pkind FROM tokens WHERE NOT ({attr_tag})),
applied AS (
  SELECT p.page_id, p.pos, p.i, p.kind, p.pkind, p.key, p.piece, m.translation IS NOT NULL AS applied,
    CASE WHEN m.translation IS NULL THEN p.piece
         WHEN p.pkind = 'text' THEN {escape_text('m.translation')}
         WHEN p.pkind = 'rawtext' THEN m.translation
         WHEN p.pkind = 'attr' THEN {sep.replace('piece', 'p.piece')} || {name.replace('piece', 'p.piece')} || '="' || {escape_attr('m.translation')} || '"'
         ELSE p.piece END AS out
  FROM pieces p LEFT JOIN tmap m ON p.page_id = m.page_id AND p.key = m.text),
rendered AS (
  SELECT page_id, string_agg(out, '' ORDER BY pos, i) AS html, CAST(count_if(applied) AS BIGINT) AS n_applied
  FROM applied GROUP BY page_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes if c.strip())
