"""Registered queries: one per operator of the inventory, each a Spark plan over
the given tables (or HTML derived from them) plus its DuckDB SQL oracle.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, sql | None)``.
Column names and types agree between both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelfold.functions import text as T
from babelfold.functions import urls as U
from babelfold.operators import apply as A
from babelfold.operators import batching as B
from babelfold.operators import memory as MEM
from babelfold.operators import metrics as M
from babelfold.operators import resources as RES
from babelfold.operators import responses as R
from babelfold.operators import segments as S
from babelfold.operators import tokens as TK
from babelfold.operators import translate as TR
from babelfold.plans import oracle as O
from babelfold.plans.pipeline import translate_pages, translate_to
from babelfold.session import checkpoint_dir, cut_lineage
from babelfold.sources import derived as D
from babelfold.sources import files as FILES
from babelfold.sources import pages as P

LANG = "zh"
# batches whose payload is over this many bytes fail in the failure scenarios
FAIL_OVER_BYTES = 3000

QUERIES: dict[str, tuple] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _pages(spark, sf_dir) -> DataFrame:
    return D.table(spark, sf_dir, "pages")


def _tokens(spark, sf_dir, src=None) -> DataFrame:
    src = src if src is not None else _pages(spark, sf_dir)
    return TK.tokenize(TK.partition_pages(src.select("page_id", "html")))


def _pipe(spark, sf_dir, src=None, **kw):
    src = src if src is not None else _pages(spark, sf_dir)
    return translate_pages(src, **kw)


def prefix_limited(lang: str, max_bytes: int) -> TR.NativeTranslator:
    """Mock service that answers with an empty body for oversized payloads."""
    base = TR.prefix(lang)
    return TR.NativeTranslator(lambda p: F.when(F.octet_length(p) > max_bytes, F.lit("")).otherwise(base.fn(p)),
                               f"prefix_limited:{lang}:{max_bytes}")


# --- SQL building blocks --------------------------------------------------------------
TOK_PAGES = O.cte_tokens("pages")
TOK_MIXED = O.cte_tokens(D.MIXED_PAGES_SQL)
PIPE_PAGES = O.with_(TOK_PAGES, O.cte_segments(), O.cte_batches(), O.cte_after_batches(LANG), O.cte_apply())


def _limited_pipe_sql(max_bytes: int) -> str:
    after = O.cte_after_batches(LANG).replace(
        f"{O.prefix_translate('payload', LANG)} AS response",
        f"CASE WHEN strlen(payload) > {max_bytes} THEN '' ELSE {O.prefix_translate('payload', LANG)} END AS response")
    return O.with_(TOK_PAGES, O.cte_segments(), O.cte_batches(), after, O.cte_apply())


PIPE_LIMITED = _limited_pipe_sql(FAIL_OVER_BYTES)

# ======================= 2.1 sources, sinks, locations ==================================


@register("src_pages", "SELECT page_id, url, html, CAST(strlen(html) AS INTEGER) AS n_bytes FROM pages")
def q_src_pages(spark, sf_dir):
    p = P.read_pages(spark, f"{sf_dir}/pages.parquet")
    return p.select("page_id", "url", "html", F.octet_length("html").alias("n_bytes"))


def _folder(spark, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _read_back(spark, out: str) -> DataFrame:
    """The files of a folder as rows, kept in a table; the folder goes."""
    f = FILES.read_html_files(spark, out)
    f = cut_lineage(f.withColumn("name", FILES.file_name(F.col("path"))))
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return f


@register("src_html_files", """SELECT CAST(page_id AS VARCHAR) || '.html' AS name, page_id % 10 <> 3 AS valid_utf8,
  CASE WHEN page_id % 10 = 3 THEN 'file' END AS error_class, CASE WHEN page_id % 10 <> 3 THEN sha256(html) END AS hash,
  CAST(strlen(html) + CASE WHEN page_id % 10 = 3 THEN 1 ELSE 0 END AS BIGINT) AS n_bytes, true AS own_id FROM pages""")
def q_src_html_files(spark, sf_dir):
    """Every page as an HTML file, some with a byte that is not UTF-8, read back as pages."""
    p = _pages(spark, sf_dir)
    raw = F.col("html").cast("binary")
    content = F.when(F.col("page_id") % 10 == 3, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw)
    out = _folder(spark, "html-files")
    FILES.write_files(p.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), content.alias("content")), out)
    f = _read_back(spark, out)
    ids = f.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return f.join(ids, "page_id").select("name", F.col("error_class").isNull().alias("valid_utf8"), "error_class", F.sha2("html", 256).alias("hash"),
                                         "n_bytes", (F.col("n") == 1).alias("own_id"))


URLS_SQL = O.with_(O.cte_urls(D.LOCATION_INPUTS_SQL, "input", "page_id, variant"))


@register("classify_source", URLS_SQL + """
SELECT page_id, variant, input, CASE WHEN host IS NOT NULL THEN 'url' ELSE 'file' END AS kind,
  CASE WHEN host IS NOT NULL OR starts_with(input, '/') THEN input ELSE '/work/' || input END AS location FROM urls""")
def q_classify_source(spark, sf_dir):
    s = U.classify_source(F.col("input"), "/work")
    return D.location_inputs(spark, sf_dir).select("page_id", "variant", "input", s["kind"].alias("kind"),
                                                   s["location"].alias("location"))


@register("url_parts", URLS_SQL + "\nSELECT page_id, variant, host, path FROM urls")
def q_url_parts(spark, sf_dir):
    u = U.parse_http_url("input")
    return D.location_inputs(spark, sf_dir).select("page_id", "variant", u["host"].alias("host"), u["path"].alias("path"))


@register("url_valid", f"""SELECT page_id, variant, input,
  coalesce(input <> '' AND (starts_with(input, 'http://') OR starts_with(input, 'https://')), false) AS valid
FROM {D.LOCATION_INPUTS_SQL}""")
def q_url_valid(spark, sf_dir):
    return D.location_inputs(spark, sf_dir).select("page_id", "variant", "input", U.is_http_url("input").alias("valid"))


def _file_paths(spark, sf_dir) -> DataFrame:
    p = _pages(spark, sf_dir)
    ext = F.element_at(F.array(*[F.lit(e) for e in (".html", ".htm", ".HTML", ".txt", "", ".tar.gz", ".")]),
                       (F.col("page_id") % 7 + 1).cast("int"))
    path = F.concat(F.lit("/d/"), F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/in"), ext)
    hidden = F.concat(F.lit("/d/.p"), F.col("page_id").cast("string"))
    return p.select("page_id", F.explode(F.array(path, hidden)).alias("path"))


FILE_PATHS_SQL = f"""(SELECT page_id, unnest(['/d/' || regexp_extract(url, '://([^/?#]*)', 1) || '/in' ||
    (['.html', '.htm', '.HTML', '.txt', '', '.tar.gz', '.'])[page_id % 7 + 1], '/d/.p' || CAST(page_id AS VARCHAR)]) AS path
  FROM pages)"""


def _sql_file_ext(x: str) -> str:
    name = f"regexp_extract({x}, {O.q(U.FILE_NAME_RE)}, 1)"
    return (f"CASE WHEN regexp_matches({name}, {O.q(U.HAS_EXT_RE)}) "
            f"THEN regexp_extract({name}, {O.q(r'^.+\.([^.]*)\z')}, 1) END")


@register("file_ext_check", f"""SELECT page_id, path, {_sql_file_ext('path')} AS ext,
  coalesce({_sql_file_ext('path')} NOT IN ('html', 'htm'), false) AS warn FROM {FILE_PATHS_SQL}""")
def q_file_ext_check(spark, sf_dir):
    f = _file_paths(spark, sf_dir)
    return f.select("page_id", "path", U.file_ext("path").alias("ext"), U.ext_warning("path").alias("warn"))


@register("page_size_guard", f"""SELECT page_id, CAST(strlen(html) AS INTEGER) AS n_bytes,
  strlen(html) <= {P.MAX_PAGE_BYTES} AS within_limit FROM pages""")
def q_page_size_guard(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.octet_length("html").alias("n_bytes"),
                                        P.within_size(F.col("html")).alias("within_limit"))


def _sql_output_name_file(x: str, lang: str) -> str:
    d = f"regexp_extract({x}, {O.q(U.FILE_DIR_RE)}, 1)"
    name = f"regexp_extract({x}, {O.q(U.FILE_NAME_RE)}, 1)"
    has = f"regexp_matches({name}, {O.q(U.HAS_EXT_RE)})"
    stem = f"CASE WHEN {has} THEN regexp_extract({name}, {O.q(r'^(.+)\.[^.]*\z')}, 1) ELSE {name} END"
    ext = f"CASE WHEN {has} THEN regexp_extract({name}, {O.q(r'^.+\.([^.]*)\z')}, 1) ELSE '' END"
    return f"{d} || {stem} || '_{lang}.' || {ext}"


@register("output_name_file", f"""SELECT page_id, path, {_sql_output_name_file('path', LANG)} AS out_name
FROM {FILE_PATHS_SQL}""")
def q_output_name_file(spark, sf_dir):
    f = _file_paths(spark, sf_dir)
    return f.select("page_id", "path", U.output_name_file("path", LANG).alias("out_name"))


_LAST = "list_filter(string_split(path, '/'), lambda s: s <> '')[-1]"
_PAGE = f"CASE WHEN contains({_LAST}, '.') THEN regexp_extract({_LAST}, {O.q(r'^(.*)[.][^.]*$')}, 1) ELSE {_LAST} END"


@register("output_name_url", URLS_SQL + f"""
SELECT page_id, variant, regexp_replace(coalesce(host, 'webpage') || '_' || coalesce({_PAGE}, 'index') || '_{LANG}.html',
  {O.q(r'[^\p{L}\p{N}_.-]')}, '_', 'g') AS out_name,
  coalesce(CASE WHEN page_id % 3 = 0 THEN 'given.html' END, regexp_replace(coalesce(host, 'webpage') || '_' || coalesce({_PAGE}, 'index') || '_{LANG}.html',
  {O.q(r'[^\p{L}\p{N}_.-]')}, '_', 'g')) AS given_name FROM urls""")
def q_output_name_url(spark, sf_dir):
    given = F.when(F.col("page_id") % 3 == 0, F.lit("given.html"))
    return D.location_inputs(spark, sf_dir).select("page_id", "variant", U.output_name_url("input", LANG).alias("out_name"),
                                                   U.output_name_url("input", LANG, given).alias("given_name"))


_CRAWL = f"translate(CASE WHEN coalesce(path, '/') = '/' THEN coalesce(host, 'unknown') || '_index' ELSE host || replace(path, '/', '_') END, {O.q('<>:\"|?*')}, '_______')"


@register("crawl_default_name", URLS_SQL + f"""
SELECT page_id, variant, regexp_replace(replace({_CRAWL}, '__', '_'), '^_+|_+$', '', 'g') || '_{D.CRAWL_EPOCH}.html' AS crawl_name FROM urls""")
def q_crawl_default_name(spark, sf_dir):
    return D.location_inputs(spark, sf_dir).select("page_id", "variant", U.crawl_name("input", D.CRAWL_EPOCH).alias("crawl_name"))


@register("provenance_header", f"""SELECT page_id, '<!-- generated by babelfold -->' || chr(10) || '<!-- source URL: ' ||
  url || ' -->' || chr(10) || '<!-- generated at: ' || strftime(TIMESTAMP '{D.RUN_TS}', '%Y-%m-%d %H:%M:%S') ||
  ' UTC -->' || chr(10) || chr(10) || html AS html FROM pages""")
def q_provenance_header(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.with_provenance(F.col("html"), F.col("url"), D.RUN_TS)
                                        .alias("html"))


@register("strip_resources", O.with_(TOK_PAGES) + f""",
st AS (SELECT page_id, pos, CASE WHEN tag = 'script' THEN ''
    WHEN kind = 'open' AND regexp_matches(raw, {O.q(r'(?i)[\t\n\f\r /]on[a-z]')})
    THEN array_to_string(list_transform(list_filter({O.attr_list('raw')}, lambda a: NOT coalesce(starts_with(a.name, 'on'), false)), lambda a: a.piece), '')
    ELSE raw END AS o FROM tokens)
SELECT page_id, string_agg(o, '' ORDER BY pos) AS html FROM st GROUP BY page_id""")
def q_strip_resources(spark, sf_dir):
    return RES.strip_resources(_tokens(spark, sf_dir))


_STRIP = """CASE WHEN (NOT js AND tag = 'script') OR (NOT css AND tag = 'style') OR (NOT css AND tag = 'link' AND kind = 'open'
      AND len(list_filter(al, lambda a: a.name = 'rel' AND regexp_matches(lower(a.value), '(^|[ \\t\\n\\f\\r])stylesheet($|[ \\t\\n\\f\\r])'))) > 0) THEN ''
    WHEN kind = 'open' THEN array_to_string(list_transform(list_filter(al, lambda a: NOT coalesce((NOT js AND starts_with(a.name, 'on'))
      OR (NOT css AND a.name = 'style') OR (NOT images AND tag IN ('img', 'source') AND a.name IN ('src', 'srcset')), false)), lambda a: a.piece), '')
    ELSE raw END"""


@register("strip_resources_switches", O.with_(O.cte_tokens(D.RESOURCE_PAGES_SQL)) + f""",
sw AS (SELECT k, k % 2 = 1 AS css, k // 2 % 2 = 1 AS js, k // 4 = 1 AS images FROM (SELECT unnest(range(0, 8)) AS k)),
al AS (SELECT *, {O.attr_list('raw')} AS al FROM tokens)
SELECT page_id, CAST(k AS INTEGER) AS switches, string_agg(o, '' ORDER BY pos) AS html FROM (
  SELECT page_id, k, pos, {_STRIP} AS o FROM al, sw) GROUP BY page_id, k""")
def q_strip_resources_switches(spark, sf_dir):
    """All eight sets of switches over pages with resources of every kind."""
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("switches")
    t = RES.with_resource_pieces(_tokens(spark, sf_dir, D.resource_pages(spark, sf_dir))).select("*", k)
    t = t.withColumns({"css": F.expr("switches % 2 = 1"), "js": F.expr("switches div 2 % 2 = 1"), "images": F.expr("switches div 4 = 1")})
    return RES.strip_resources(t, "css", "js", "images", by=("switches",))


@register("page_title", O.with_(TOK_PAGES) + f""",
pt AS (SELECT page_id, pos, kind, raw, lag(tag) OVER (PARTITION BY page_id ORDER BY pos) AS prev_tag,
              lag(kind) OVER (PARTITION BY page_id ORDER BY pos) AS prev_kind FROM tokens)
SELECT page_id, arg_min({O.trim_ws(O.decode('raw'))}, pos) AS title FROM pt
WHERE kind = 'text' AND prev_kind = 'open' AND prev_tag = 'title' GROUP BY page_id""")
def q_page_title(spark, sf_dir):
    return RES.page_title(_tokens(spark, sf_dir))


_NAMED = f"""named AS (SELECT u.page_id, regexp_replace(coalesce(host, 'webpage') || '_' || coalesce({_PAGE}, 'index') || '_{LANG}.html',
  {O.q(r'[^\p{L}\p{N}_.-]')}, '_', 'g') AS out_name FROM urls u)"""


@register("sink_translated", O.with_(TOK_PAGES, O.cte_segments(), O.cte_batches(), O.cte_after_batches(LANG), O.cte_apply(),
                                     O.cte_urls("pages", "url", "page_id"), _NAMED) + """
SELECT CASE WHEN count(*) OVER (PARTITION BY n.out_name) > 1 THEN regexp_replace(n.out_name, '[.]html$', '') || '_' || CAST(p.page_id AS VARCHAR) || '.html'
       ELSE n.out_name END AS name, sha256(coalesce(r.html, p.html)) AS hash, CAST(strlen(coalesce(r.html, p.html)) AS BIGINT) AS n_bytes
FROM pages p JOIN named n ON n.page_id = p.page_id LEFT JOIN rendered r ON p.page_id = r.page_id""")
def q_sink_translated(spark, sf_dir):
    """Translated pages written as files under their output names, read back."""
    out = _folder(spark, "translated")
    P.write_translated_files(_pipe(spark, sf_dir).pages, _pages(spark, sf_dir), out, LANG)
    return _read_back(spark, out).select("name", F.sha2("html", 256).alias("hash"), "n_bytes")


@register("sink_table", O.with_(TOK_PAGES, O.cte_segments(), O.cte_batches(), O.cte_after_batches(LANG), O.cte_apply()) + f"""
SELECT p.page_id, '{LANG}' AS lang, CAST(strlen(coalesce(r.html, p.html)) AS INTEGER) AS n_bytes
FROM pages p LEFT JOIN rendered r ON p.page_id = r.page_id""")
def q_sink_table(spark, sf_dir):
    """Translated pages as a table partitioned by language, read back."""
    out = _folder(spark, "translated")
    P.write_pages(_pipe(spark, sf_dir).pages.select("page_id", "html", F.lit(LANG).alias("lang")), out)
    return spark.read.parquet(out).select("page_id", "lang", F.octet_length("html").alias("n_bytes"))


# ======================= 2.2 extraction ==================================================

@register("html_tokens", O.with_(TOK_PAGES) + "\nSELECT page_id, pos, kind, tag, level, raw FROM tokens")
def q_html_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("page_id", "pos", "kind", "tag", "level", "raw")


TOK_CONTENT = O.cte_tokens(D.CONTENT_PAGES_SQL)


@register("content_model_tokens", O.with_(TOK_CONTENT) + "\nSELECT page_id, pos, kind, tag, level, raw FROM tokens")
def q_content_model_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir, D.content_pages(spark, sf_dir)).select("page_id", "pos", "kind", "tag", "level", "raw")


@register("content_model_segments", O.with_(TOK_CONTENT, O.cte_segments())
          + "\nSELECT page_id, seq, kind, tag, attr, text FROM segments")
def q_content_model_segments(spark, sf_dir):
    return S.extract_segments(_tokens(spark, sf_dir, D.content_pages(spark, sf_dir)))


@register("content_model_render", O.with_(TOK_CONTENT, O.cte_segments(), O.cte_batches(), O.cte_after_batches(LANG), O.cte_apply())
          + "\nSELECT page_id, html, n_applied FROM rendered")
def q_content_model_render(spark, sf_dir):
    r = _pipe(spark, sf_dir, D.content_pages(spark, sf_dir))
    return A.render(r.applied).select("page_id", "html", "n_applied")


SEG_PAGES = O.with_(TOK_PAGES, O.cte_segments())


@register("seg_text", SEG_PAGES + "\nSELECT page_id, seq, text FROM segments WHERE kind = 'text'")
def q_seg_text(spark, sf_dir):
    s = S.extract_segments(_tokens(spark, sf_dir))
    return s.filter(F.col("kind") == "text").select("page_id", "seq", "text")


@register("seg_attr", O.with_(O.cte_tokens(D.ATTR_PAGES_SQL), O.cte_segments())
          + "\nSELECT page_id, seq, kind, tag, attr, text FROM segments")
def q_seg_attr(spark, sf_dir):
    s = S.extract_segments(_tokens(spark, sf_dir, D.attr_pages(spark, sf_dir)))
    return s.select("page_id", "seq", "kind", "tag", "attr", "text")


def _cand_query(spark, sf_dir, src, kind, iframe_mode="off"):
    c = S.candidates(_tokens(spark, sf_dir, src), iframe_mode)
    return c.filter(F.col("kind") == kind).select("page_id", "o_pos", "o_a", "o_b", "o_c", "text")


def _cand_sql(src_sql: str, kind: str, iframe_mode: str = "off") -> str:
    return (O.with_(O.cte_tokens(src_sql), O.cte_segments(iframe_mode))
            + f"\nSELECT page_id, o_pos, o_a, o_b, o_c, text FROM cand WHERE kind = '{kind}'")


for _kind, _src, _src_sql in (("js_string", "script", D.SCRIPT_PAGES_SQL), ("json_text", "script", D.SCRIPT_PAGES_SQL),
                              ("json_key", "script", D.SCRIPT_PAGES_SQL), ("json_kv", "script", D.SCRIPT_PAGES_SQL)):
    def _mk(kind):
        def fn(spark, sf_dir):
            return _cand_query(spark, sf_dir, D.script_pages(spark, sf_dir), kind)
        return fn
    QUERIES[f"seg_{_kind}"] = (_mk(_kind), _cand_sql(_src_sql, _kind))


@register("seg_js_string_pages", _cand_sql("pages", "js_string"))
def q_seg_js_string_pages(spark, sf_dir):
    return _cand_query(spark, sf_dir, _pages(spark, sf_dir), "js_string")


@register("iframe_decode", O.with_(O.cte_tokens(D.IFRAME_PAGES_SQL), O.cte_iframes())
          + "\nSELECT page_id, pos, CAST(src_i AS INTEGER) AS src_i, h AS html FROM iframes")
def q_iframe_decode(spark, sf_dir):
    t = _tokens(spark, sf_dir, D.iframe_pages(spark, sf_dir))
    t = S.with_pieces(t, "kind = 'open' AND tag = 'iframe'")
    t = t.filter(F.expr(f"{S.sql_iframe_src_i('a0')} IS NOT NULL"))
    return t.select("page_id", "pos", F.expr(S.sql_iframe_src_i("a0")).alias("src_i"),
                    F.expr(S.sql_iframe_html("a0")).alias("html"))


@register("seg_iframe_text", _cand_sql(D.IFRAME_PAGES_SQL, "iframe_text", "repaired"))
def q_seg_iframe_text(spark, sf_dir):
    return _cand_query(spark, sf_dir, D.iframe_pages(spark, sf_dir), "iframe_text", "repaired")


@register("seg_iframe_phrase", _cand_sql(D.IFRAME_PAGES_SQL, "iframe_phrase", "repaired"))
def q_seg_iframe_phrase(spark, sf_dir):
    return _cand_query(spark, sf_dir, D.iframe_pages(spark, sf_dir), "iframe_phrase", "repaired")


@register("segments", O.with_(TOK_MIXED, O.cte_segments())
          + "\nSELECT page_id, seq, kind, tag, attr, text FROM segments")
def q_segments(spark, sf_dir):
    return S.extract_segments(_tokens(spark, sf_dir, D.mixed_pages(spark, sf_dir)))


@register("segment_counts", O.with_(TOK_MIXED, O.cte_segments())
          + "\nSELECT page_id, kind, count(*) AS n_segments FROM segments GROUP BY page_id, kind")
def q_segment_counts(spark, sf_dir):
    return S.segment_counts(S.extract_segments(_tokens(spark, sf_dir, D.mixed_pages(spark, sf_dir))))


# ======================= 2.3 predicates ==================================================

def _lines(spark, sf_dir):
    d = D.doc_lines(spark, sf_dir).select(F.lit("documents").alias("source"), "doc_id", F.lit(0).cast("long").alias("turn"), "seq", "line")
    c = D.spread(D.table(spark, sf_dir, "conversations"), "conv_id").select(
        F.lit("conversations").alias("source"), F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("turn"),
        F.posexplode(F.split("text", "\n", -1)).alias("seq", "line")).withColumn("seq", F.col("seq").cast("long"))
    return d.unionByName(c)


LINES_SQL = (f"(SELECT 'documents' AS source, doc_id, CAST(0 AS BIGINT) AS turn, seq, line FROM {D.doc_lines_sql()} UNION ALL "
             "SELECT 'conversations', doc_id, turn, seq, line FROM (SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS turn, "
             "CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS seq, unnest(ls) AS line FROM "
             "(SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)))")


@register("is_translatable", f"""SELECT source, doc_id, turn, seq, t AS text, {O.translatable('t')} AS ok,
  {O.text_kept('t')} AS text_rule FROM (SELECT source, doc_id, turn, seq, {O.trim_ws('line')} AS t FROM {LINES_SQL})""")
def q_is_translatable(spark, sf_dir):
    l = _lines(spark, sf_dir).select("source", "doc_id", "turn", "seq", T.trim_ws(F.col("line")).alias("text"))
    return l.select("source", "doc_id", "turn", "seq", "text", T.is_translatable(F.col("text")).alias("ok"),
                    T.is_text_node_kept(F.col("text")).alias("text_rule"))


@register("lang_supported", f"""SELECT doc_id, lang, coalesce(lang IN {O.inlist(B.SUPPORTED_LANGUAGES)}, false) AS supported,
  coalesce(upper(lang) IN {O.inlist(B.SUPPORTED_LANGUAGES)}, false) AS supported_upper FROM documents""")
def q_lang_supported(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", B.lang_supported(F.col("lang")).alias("supported"),
                    B.lang_supported(F.upper("lang")).alias("supported_upper"))


# ======================= 2.4 batching ====================================================

@register("batch_plan", O.with_(TOK_PAGES, O.cte_segments(), O.cte_batches())
          + "\nSELECT page_id, seq, n, batch_size, batch_idx FROM planned")
def q_batch_plan(spark, sf_dir):
    s = S.extract_segments(_tokens(spark, sf_dir))
    return B.plan_batches(s).select("page_id", "seq", "n", "batch_size", "batch_idx")


CONV_SEGS_SQL = "(SELECT conv_id, turn AS seq, text FROM conversations)"


@register("batch_payload", O.with_(O.cte_batches(src=CONV_SEGS_SQL, group="conv_id"))
          + "\nSELECT conv_id, batch_idx, payload, n_items, first_seq, n FROM batches")
def q_batch_payload(spark, sf_dir):
    c = D.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "text")
    c = c.repartition("conv_id")
    b = B.build_payload(B.plan_batches(c, group_col="conv_id"), group_col="conv_id")
    return b.select("conv_id", "batch_idx", "payload", "n_items", "first_seq", "n")


@register("request_body", O.with_(TOK_PAGES, O.cte_segments(), O.cte_batches())
          + f"\nSELECT page_id, batch_idx, payload AS text, 'auto' AS source_lang, '{LANG}' AS target_lang FROM batches")
def q_request_body(spark, sf_dir):
    s = S.extract_segments(_tokens(spark, sf_dir))
    b = B.build_payload(B.plan_batches(s))
    body = B.request_json(F.col("payload"), LANG)
    return b.select("page_id", "batch_idx", F.get_json_object(body, "$.text").alias("text"),
                    F.get_json_object(body, "$.source_lang").alias("source_lang"),
                    F.get_json_object(body, "$.target_lang").alias("target_lang"))


@register("translate_batches", O.with_(TOK_PAGES, O.cte_segments(), O.cte_batches())
          + f"\nSELECT page_id, batch_idx, {O.prefix_translate('payload', LANG)} AS response, "
            "CAST(NULL AS VARCHAR) AS error_class FROM batches")
def q_translate_batches(spark, sf_dir):
    s = S.extract_segments(_tokens(spark, sf_dir))
    b = B.build_payload(B.plan_batches(s))
    r = TR.translate_batches(b, TR.python_prefix(LANG))
    return r.select("page_id", "batch_idx", "response", "error_class")


DICT_SEGS_SQL = f"(SELECT doc_id, seq, {O.trim_ws('line')} AS text FROM {D.doc_lines_sql()} WHERE {O.trim_ws('line')} <> '')"
DICT_SQL = (f"(SELECT DISTINCT t AS text, '{LANG}:' || t AS translation FROM (SELECT {O.trim_ws('line')} AS t "
            f"FROM {D.doc_lines_sql('benchmark', 'item_id')}) WHERE t <> '')")


@register("translate_dictionary", O.with_(O.cte_batches(src=DICT_SEGS_SQL, group="doc_id")) + f"""
SELECT p.doc_id AS page_id, p.batch_idx, max(p.n) AS n,
  coalesce(string_agg('[' || CAST(p.seq AS VARCHAR) || '] ' || d.translation, chr(10) ORDER BY p.seq), '') AS response
FROM planned p LEFT JOIN {DICT_SQL} d ON p.text = d.text GROUP BY p.doc_id, p.batch_idx""")
def q_translate_dictionary(spark, sf_dir):
    """Document lines translated from a table of benchmark lines."""
    b = B.build_payload(B.plan_batches(_doc_segments(spark, sf_dir), group_col="doc_id"), group_col="doc_id")
    r = TR.translate_batches(b, TR.TableTranslator(_memory(spark, sf_dir)), group_col="doc_id", lang=LANG)
    return r.select("page_id", "batch_idx", "n", "response")


@register("resend_failed", O.with_(TOK_PAGES, O.cte_segments(), O.cte_batches()) + f"""
SELECT page_id, batch_idx, CASE WHEN strlen(payload) > {FAIL_OVER_BYTES} THEN 'api' END AS error_class,
  CASE WHEN strlen(payload) > {FAIL_OVER_BYTES} THEN 3 ELSE 1 END AS round FROM batches""")
def q_resend_failed(spark, sf_dir):
    """Batches that a service always refuses are sent in every round, the others once."""
    b = B.build_payload(B.plan_batches(S.extract_segments(_tokens(spark, sf_dir))))
    r = TR.translate_with_resends(b, TR.python_prefix(LANG, fail_over_bytes=FAIL_OVER_BYTES), rounds=3)
    return r.select("page_id", "batch_idx", "error_class", "round")


@register("distinct_sending", SEG_PAGES + """
SELECT text, CAST(1 AS BIGINT) AS n_sent, count(*) AS n_pages FROM segments GROUP BY text""")
def q_distinct_sending(spark, sf_dir):
    """How often each text is sent, and on how many pages its translation is used."""
    r = _pipe(spark, sf_dir, distinct=True)
    sent = r.batches.select(F.explode("items.text").alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n_sent"))
    used = r.segments.groupBy("text").agg(F.count(F.lit(1)).alias("n_pages"))
    return sent.join(used, "text", "full")


# ======================= 2.5 responses ===================================================

@register("unwrap_response", f"SELECT event_id, body, {O.unwrap('body')} AS text FROM {D.RESPONSE_BODIES_SQL}")
def q_unwrap_response(spark, sf_dir):
    b = D.response_bodies(spark, sf_dir)
    return b.select("event_id", "body", R.unwrap_response(F.col("body")).alias("text"))


MARKED_DOCS = O.cte_marked(D.MARKER_RESPONSES_SQL, group="doc_id", extra="")


@register("parse_markers", O.with_(MARKED_DOCS) + "\nSELECT doc_id, batch_idx, line_no, seq, text FROM marked")
def q_parse_markers(spark, sf_dir):
    return R.parse_markers(D.marker_responses(spark, sf_dir), group_col="doc_id")


DOC_N_SQL = f"(SELECT doc_id, count(*) AS n FROM {D.doc_lines_sql()} GROUP BY doc_id)"


def _doc_marked_with_n(spark, sf_dir):
    m = R.parse_markers(D.marker_responses(spark, sf_dir), group_col="doc_id")
    segs = D.doc_lines(spark, sf_dir)
    return R.with_counts(m, segs, "doc_id")


@register("scatter", O.with_(MARKED_DOCS) + f"""
SELECT m.doc_id, m.seq, arg_max(m.text, m.batch_idx * 4294967296 + m.line_no) AS translation
FROM marked m JOIN {DOC_N_SQL} c ON m.doc_id = c.doc_id WHERE m.seq < c.n GROUP BY m.doc_id, m.seq""")
def q_scatter(spark, sf_dir):
    return R.scatter(_doc_marked_with_n(spark, sf_dir), "doc_id")


@register("success_rate", O.with_(MARKED_DOCS) + f""",
acc AS (SELECT m.doc_id, count(*) AS n_accepted, count(DISTINCT m.seq) AS n_covered
        FROM marked m JOIN {DOC_N_SQL} c ON m.doc_id = c.doc_id WHERE m.seq < c.n GROUP BY m.doc_id)
SELECT c.doc_id, c.n, coalesce(a.n_accepted, 0) AS n_accepted, coalesce(a.n_covered, 0) AS n_covered,
  CAST(coalesce(a.n_accepted, 0) AS DOUBLE) * 100.0 / c.n AS success_rate,
  CAST(coalesce(a.n_covered, 0) AS DOUBLE) * 100.0 / c.n AS covered_rate
FROM {DOC_N_SQL} c LEFT JOIN acc a ON c.doc_id = a.doc_id""")
def q_success_rate(spark, sf_dir):
    m = _doc_marked_with_n(spark, sf_dir)
    counts = D.doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return R.success_rate(m, counts, "doc_id")


@register("failed_batches", O.with_(TOK_PAGES, O.cte_segments(), O.cte_batches())
          + f"\nSELECT 'api' AS error_class, count(*) AS n_batches FROM batches WHERE strlen(payload) > {FAIL_OVER_BYTES}")
def q_failed_batches(spark, sf_dir):
    s = S.extract_segments(_tokens(spark, sf_dir))
    b = B.build_payload(B.plan_batches(s))
    r = TR.translate_batches(b, TR.python_prefix(LANG, fail_over_bytes=FAIL_OVER_BYTES))
    return R.failed_batches(r)


# ======================= 2.6 applying ====================================================

@register("translation_map", PIPE_PAGES + "\nSELECT page_id, text, translation FROM tmap")
def q_translation_map(spark, sf_dir):
    return _pipe(spark, sf_dir).tmap


@register("apply_text", PIPE_PAGES + "\nSELECT page_id, pos, key, out FROM applied WHERE applied AND pkind <> 'attr'")
def q_apply_text(spark, sf_dir):
    a = _pipe(spark, sf_dir).applied
    return a.filter(F.col("applied") & (F.col("pkind") != "attr")).select("page_id", "pos", "key", "out")


PIPE_ATTR = O.with_(O.cte_tokens(D.ATTR_PAGES_SQL), O.cte_segments(), O.cte_batches(), O.cte_after_batches(LANG),
                    O.cte_apply())


@register("apply_attr", PIPE_ATTR + "\nSELECT page_id, pos, i, key, out FROM applied WHERE applied AND pkind = 'attr'")
def q_apply_attr(spark, sf_dir):
    a = _pipe(spark, sf_dir, D.attr_pages(spark, sf_dir)).applied
    return a.filter(F.col("applied") & (F.col("pkind") == "attr")).select("page_id", "pos", "i", "key", "out")


@register("missing_report", PIPE_LIMITED + f"""
SELECT page_id, pos, text FROM (
  SELECT t.page_id, t.pos, {O.trim_ws(O.decode('t.raw'))} AS text FROM tokens t WHERE t.kind = 'text') x
WHERE {O.text_kept('text')} AND NOT EXISTS (SELECT 1 FROM tmap m WHERE m.page_id = x.page_id AND m.text = x.text)""")
def q_missing_report(spark, sf_dir):
    r = _pipe(spark, sf_dir, translator=prefix_limited(LANG, FAIL_OVER_BYTES))
    return A.missing_report(r.tokens, r.tmap)


@register("unapplied_report", PIPE_PAGES + """
SELECT page_id, text, translation FROM tmap m
WHERE NOT EXISTS (SELECT 1 FROM pieces p WHERE p.page_id = m.page_id AND p.key = m.text)""")
def q_unapplied_report(spark, sf_dir):
    r = _pipe(spark, sf_dir)
    return A.unapplied_report(r.tokens, r.tmap)


@register("applied_count", PIPE_LIMITED + """
SELECT page_id, CAST(count_if(applied AND pkind <> 'attr') AS BIGINT) AS n_text_applied,
  CAST(count_if(applied AND pkind = 'attr') AS BIGINT) AS n_attr_applied,
  CAST(count_if(applied) AS BIGINT) AS n_applied FROM applied GROUP BY page_id""")
def q_applied_count(spark, sf_dir):
    r = _pipe(spark, sf_dir, translator=prefix_limited(LANG, FAIL_OVER_BYTES))
    return A.applied_count(r.applied)


PIPE_MIXED = O.with_(TOK_MIXED, O.cte_segments(), O.cte_batches(), O.cte_after_batches(LANG), O.cte_apply())


@register("render_html", PIPE_MIXED + "\nSELECT page_id, html, n_applied FROM rendered")
def q_render_html(spark, sf_dir):
    r = _pipe(spark, sf_dir, D.mixed_pages(spark, sf_dir))
    return A.render(r.applied).select("page_id", "html", "n_applied")


PASS_SRC_SQL = f"(SELECT page_id * {D.SETS} AS page_id, html FROM pages UNION ALL SELECT page_id, html FROM {D.BARE_PAGES_SQL})"
PIPE_PASS = O.with_(O.cte_tokens(PASS_SRC_SQL), O.cte_segments(), O.cte_batches(), O.cte_after_batches(LANG),
                    O.cte_apply())


@register("passthrough", PIPE_PASS + f"""
SELECT s.page_id, coalesce(r.html, s.html) AS html, coalesce(r.html, s.html) = s.html AS unchanged,
  coalesce(r.n_applied, 0) AS n_applied
FROM {PASS_SRC_SQL} s LEFT JOIN rendered r ON s.page_id = r.page_id""")
def q_passthrough(spark, sf_dir):
    src = _pages(spark, sf_dir).select((F.col("page_id") * D.SETS).alias("page_id"), "html").unionByName(D.bare_pages(spark, sf_dir))
    out = _pipe(spark, sf_dir, src).pages
    j = out.join(src.select("page_id", F.col("html").alias("html_in")), "page_id")
    return j.select("page_id", "html", (F.col("html") == F.col("html_in")).alias("unchanged"), "n_applied")


# ======================= 2.7 metrics =====================================================

@register("size_metrics", PIPE_PAGES + """
SELECT p.page_id, CAST(strlen(p.html) AS INTEGER) AS bytes_in, CAST(strlen(coalesce(r.html, p.html)) AS INTEGER) AS bytes_out,
  strlen(p.html) / 1024.0 AS kb_in, strlen(coalesce(r.html, p.html)) / 1024.0 AS kb_out,
  (CASE WHEN strlen(p.html) = 0 THEN NULL ELSE CAST(strlen(coalesce(r.html, p.html)) AS DOUBLE) / CAST(strlen(p.html) AS DOUBLE) END - 1.0) * 100.0 AS change_pct
FROM pages p LEFT JOIN rendered r ON p.page_id = r.page_id""")
def q_size_metrics(spark, sf_dir):
    out = _pipe(spark, sf_dir).pages
    return out.select("page_id", *M.size_metrics(F.col("bytes_in").cast("int"), F.octet_length("html")))


EVENT_MS_SQL = "(SELECT event_id, user_id, CAST(floor(value * 100) AS BIGINT) AS ms FROM events)"


def _event_ms(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.floor(F.col("value") * 100).cast("long").alias("ms"))


@register("throughput", f"""SELECT event_id, ms, CAST(user_id AS BIGINT) * 1024 + event_id AS n_bytes,
  CASE WHEN ms = 0 THEN NULL ELSE (CAST(user_id AS BIGINT) * 1024 + event_id) / 1024.0 / (ms / 1000.0) END AS kb_per_s
FROM {EVENT_MS_SQL}""")
def q_throughput(spark, sf_dir):
    e = _event_ms(spark, sf_dir).withColumn("n_bytes", F.col("user_id").cast("long") * 1024 + F.col("event_id"))
    return e.select("event_id", "ms", "n_bytes", M.throughput_kbps("n_bytes", "ms").alias("kb_per_s"))


@register("perf_grade", f"""SELECT event_id, ms, CASE WHEN ms <= 500 THEN 1 WHEN ms <= 800 THEN 2 WHEN ms <= 1000 THEN 3 ELSE 4 END AS grade,
  CASE WHEN ms <= 500 THEN 'excellent' WHEN ms <= 800 THEN 'good' WHEN ms <= 1000 THEN 'pass' ELSE 'slow' END AS label
FROM {EVENT_MS_SQL}""")
def q_perf_grade(spark, sf_dir):
    e = _event_ms(spark, sf_dir)
    g = M.perf_grade("ms")
    return e.select("event_id", "ms", g.alias("grade"), M.grade_label(g).alias("label"))


@register("target_check", f"SELECT event_id, ms, ms < 1000 AS target_met FROM {EVENT_MS_SQL}")
def q_target_check(spark, sf_dir):
    return _event_ms(spark, sf_dir).select("event_id", "ms", M.target_met("ms").alias("target_met"))


@register("format_duration", f"""SELECT event_id, ms, CASE WHEN ms < 1000 THEN CAST(ms AS VARCHAR) || 'ms'
  ELSE CAST(ms // 1000 AS VARCHAR) || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 's' END AS text FROM {EVENT_MS_SQL}""")
def q_format_duration(spark, sf_dir):
    return _event_ms(spark, sf_dir).select("event_id", "ms", M.format_duration("ms").alias("text"))


def _memory(spark, sf_dir, run_ts: int = 1):
    b = D.doc_lines(spark, sf_dir, "benchmark", "item_id").select(T.trim_ws(F.col("line")).alias("text"))
    b = b.filter(F.col("text") != "").distinct()
    return b.select(F.lit(LANG).alias("lang"), "text", F.concat(F.lit(f"{LANG}:"), F.col("text")).alias("translation"),
                    F.lit(run_ts).cast("long").alias("run_ts"))


MEMORY_SQL = (f"(SELECT DISTINCT '{LANG}' AS lang, t AS text, '{LANG}:' || t AS translation, CAST(1 AS BIGINT) AS run_ts "
              f"FROM (SELECT {O.trim_ws('line')} AS t FROM {D.doc_lines_sql('benchmark', 'item_id')}) WHERE t <> '')")
DOC_SEGS_SQL = f"(SELECT doc_id, seq, {O.trim_ws('line')} AS text FROM {D.doc_lines_sql()} WHERE {O.trim_ws('line')} <> '')"


def _doc_segments(spark, sf_dir):
    d = D.doc_lines(spark, sf_dir).select("doc_id", "seq", T.trim_ws(F.col("line")).alias("text"))
    return d.filter(F.col("text") != "")


@register("cache_hit_rate", f"""SELECT s.doc_id, count(m.text) AS hits, count(*) - count(m.text) AS misses,
  CASE WHEN count(*) > 0 THEN CAST(count(m.text) AS DOUBLE) / CAST(count(*) AS DOUBLE) END AS hit_rate
FROM {DOC_SEGS_SQL} s LEFT JOIN {MEMORY_SQL} m ON s.text = m.text GROUP BY s.doc_id""")
def q_cache_hit_rate(spark, sf_dir):
    t = MEM.tm_split(_doc_segments(spark, sf_dir), _memory(spark, sf_dir), LANG)
    g = t.groupBy("doc_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return g.select("doc_id", "hits", "misses", M.hit_rate("hits", "misses").alias("hit_rate"))


_METRICS_SQL = """
SELECT p.page_id, CAST(strlen(p.html) AS INTEGER) AS bytes_in, CAST(strlen(coalesce(r.html, p.html)) AS INTEGER) AS bytes_out,
  coalesce((SELECT count(*) FROM segments s WHERE s.page_id = p.page_id), 0) AS n_segments,
  coalesce((SELECT count(*) FROM hits h WHERE h.page_id = p.page_id), 0) AS n_hits,
  coalesce((SELECT count(*) FROM missed s WHERE s.page_id = p.page_id), 0) AS n_misses,
  coalesce((SELECT count(*) FROM batches b WHERE b.page_id = p.page_id), 0) AS n_batches,
  coalesce((SELECT count(error_class) FROM responses x WHERE x.page_id = p.page_id), 0) AS n_failed_batches,
  coalesce((SELECT count(*) FROM marked m WHERE m.page_id = p.page_id AND m.seq < m.n), 0) AS n_accepted,
  coalesce(r.n_applied, 0) AS n_applied
FROM pages p LEFT JOIN rendered r ON p.page_id = r.page_id"""
# a memory of every second text (by length): its entries are not sent, the others are renumbered
_HALF_MEMORY_SQL = f"""
known AS (SELECT DISTINCT text, '{LANG}*' || text AS translation FROM segments WHERE length(text) % 2 = 0),
hits AS (SELECT s.page_id, s.text, k.translation FROM segments s JOIN known k ON s.text = k.text),
missed AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY seq) - 1 AS BIGINT) AS seq, text
           FROM segments s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.text = s.text))"""
_APPLY_HALF = O.cte_apply().replace("FROM segments s JOIN translations t ON s.page_id = t.page_id AND s.seq = t.seq\n  WHERE t.translation <> '')",
                                    "FROM missed s JOIN translations t ON s.page_id = t.page_id AND s.seq = t.seq\n  WHERE t.translation <> ''\n"
                                    "  UNION ALL SELECT page_id, text, translation FROM hits)")
PIPE_HALF = O.with_(TOK_PAGES, O.cte_segments(), _HALF_MEMORY_SQL, O.cte_batches(src="missed"), O.cte_after_batches(LANG), _APPLY_HALF)
PIPE_NO_MEMORY = O.with_(TOK_PAGES, O.cte_segments(), "\nhits AS (SELECT page_id FROM segments WHERE false), missed AS (SELECT * FROM segments)",
                         O.cte_batches(), O.cte_after_batches(LANG), O.cte_apply())


def _half_memory(spark, sf_dir) -> DataFrame:
    texts = S.extract_segments(_tokens(spark, sf_dir)).select("text").distinct().filter(F.length("text") % 2 == 0)
    return texts.select(F.lit(LANG).alias("lang"), "text", F.concat(F.lit(f"{LANG}*"), F.col("text")).alias("translation"),
                        F.lit(1).cast("long").alias("run_ts"))


@register("run_metrics", PIPE_NO_MEMORY + _METRICS_SQL)
def q_run_metrics(spark, sf_dir):
    r = _pipe(spark, sf_dir)
    return M.run_metrics(r.pages, r.responses)


@register("run_metrics_memory", PIPE_HALF + _METRICS_SQL)
def q_run_metrics_memory(spark, sf_dir):
    r = _pipe(spark, sf_dir, memory=_half_memory(spark, sf_dir))
    return M.run_metrics(r.pages, r.responses, r.split)


@register("run_report", PIPE_HALF + """,
t AS (SELECT count(*) AS n_pages, sum(strlen(p.html)) AS bytes_in, sum(strlen(coalesce(r.html, p.html))) AS bytes_out, sum(coalesce(r.n_applied, 0)) AS n_applied
      FROM pages p LEFT JOIN rendered r ON p.page_id = r.page_id)
SELECT n_pages, CAST(bytes_in AS BIGINT) AS bytes_in, CAST(bytes_out AS BIGINT) AS bytes_out, CAST(n_applied AS BIGINT) AS n_applied,
  (SELECT count(*) FROM cand) AS texts_collected, (SELECT count(*) FROM segments) AS texts_kept,
  (SELECT count(*) FROM cand) - (SELECT count(*) FROM segments) AS texts_filtered,
  (SELECT count(*) FROM hits) AS n_hits, (SELECT count(*) FROM missed) AS n_misses,
  CAST((SELECT count(*) FROM hits) AS DOUBLE) / CAST((SELECT count(*) FROM segments) AS DOUBLE) AS hit_rate,
  (SELECT count(*) FROM batches) AS n_batches, CAST(0 AS BIGINT) AS n_failed_batches, true AS timed FROM t""")
def q_run_report(spark, sf_dir):
    """The report of a whole run that writes its pages (its times can't be compared)."""
    r = translate_to(_pages(spark, sf_dir), _folder(spark, "run"), LANG, memory=_half_memory(spark, sf_dir))
    timed = (F.col("ms") > 0) & (F.col("kb_per_s") > 0) & F.col("label").isNotNull() & F.col("duration").isNotNull()
    return r.select("n_pages", "bytes_in", "bytes_out", "n_applied", "texts_collected", "texts_kept", "texts_filtered", "n_hits", "n_misses", "hit_rate",
                    "n_batches", "n_failed_batches", timed.alias("timed"))


# ======================= 2.8 reuse =======================================================

@register("content_hash", "SELECT page_id, sha256(html) AS hash FROM pages")
def q_content_hash(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", MEM.content_hash("html").alias("hash"))


@register("page_dedup", """SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS rep_id,
  count(*) OVER (PARTITION BY sha256(text)) AS n_copies FROM documents""")
def q_page_dedup(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("html"))
    return MEM.dedup_pages(d, "doc_id")


@register("tm_lookup", f"""SELECT s.doc_id, s.seq, s.text, m.translation, m.translation IS NOT NULL AS hit
FROM {DOC_SEGS_SQL} s LEFT JOIN {MEMORY_SQL} m ON s.text = m.text""")
def q_tm_lookup(spark, sf_dir):
    t = MEM.tm_split(_doc_segments(spark, sf_dir), _memory(spark, sf_dir), LANG)
    return t.select("doc_id", "seq", "text", "translation", "hit")


@register("tm_update", f"""WITH new AS (
  SELECT DISTINCT '{LANG}' AS lang, text, '{LANG}2:' || text AS translation, CAST(2 AS BIGINT) AS run_ts
  FROM {DOC_SEGS_SQL} WHERE {O.translatable('text')}),
u AS (SELECT * FROM {MEMORY_SQL} UNION ALL SELECT * FROM new)
SELECT lang, text, arg_max(translation, struct_pack(r := run_ts, t := translation)) AS translation, max(run_ts) AS run_ts
FROM u GROUP BY lang, text""")
def q_tm_update(spark, sf_dir):
    new = _doc_segments(spark, sf_dir).filter(T.is_translatable(F.col("text"))).select("text").distinct()
    new = new.select(F.lit(LANG).alias("lang"), "text", F.concat(F.lit(f"{LANG}2:"), F.col("text")).alias("translation"),
                     F.lit(2).cast("long").alias("run_ts"))
    return MEM.tm_merge(_memory(spark, sf_dir), new)


@register("tm_update_table", QUERIES["tm_update"][1])
def q_tm_update_table(spark, sf_dir):
    """The same merge in a memory kept as a bucketed table, in two updates."""
    t = MEM.MemoryTable(spark, _folder(spark, "memory"), buckets=16)
    t.update(_memory(spark, sf_dir))
    new = _doc_segments(spark, sf_dir).filter(T.is_translatable(F.col("text"))).select("text").distinct()
    t.update(new.select(F.lit(LANG).alias("lang"), "text", F.concat(F.lit(f"{LANG}2:"), F.col("text")).alias("translation"),
                        F.lit(2).cast("long").alias("run_ts")))
    return t.read()


# ======================= 2.9 end to end ==================================================

@register("translate_pages", PIPE_PAGES + """
SELECT p.page_id, coalesce(r.html, p.html) AS html, coalesce(r.n_applied, 0) AS n_applied
FROM pages p LEFT JOIN rendered r ON p.page_id = r.page_id""")
def q_translate_pages(spark, sf_dir):
    return _pipe(spark, sf_dir).pages.select("page_id", "html", "n_applied")


@register("translate_pages_distinct", QUERIES["translate_pages"][1])
def q_translate_pages_distinct(spark, sf_dir):
    """Every distinct text of the corpus sent once: the same pages as page by page."""
    return _pipe(spark, sf_dir, distinct=True).pages.select("page_id", "html", "n_applied")


def queries() -> dict:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in QUERIES.items() if v[1] is not None}
