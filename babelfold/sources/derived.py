"""Inputs derived from the given tables, built by the same expression in Spark
and in the SQL oracle.

``pages`` has no title/alt/placeholder attributes, JSON in scripts or iframes,
so those operators run on HTML built in-query from other tables; the work
still grows with the tables.  Each builder returns a Spark DataFrame; the
``*_sql`` twin returns a SQL relation over the same parquet views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# in a mixed page set a page's id is ``SETS * id + set``: no two sets meet, whatever their ids
SETS, PAGES_SET, ATTR_SET, SCRIPT_SET, IFRAME_SET, BARE_SET = 8, 0, 1, 2, 3, 4
# epoch and timestamp parameters, fixed so runs are repeatable
CRAWL_EPOCH = 1_700_000_000
RUN_TS = "2024-01-01 12:34:56"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows of a text table on their key before per-line regex work.

    The text work is CPU-bound and a file may be one row group (one scan
    task); hashing on the key spreads it over all cores and lets the later
    per-key aggregates reuse the partitioning instead of shuffling again.
    """
    return df.repartition(key)


# --- derived HTML ----------------------------------------------------------------------

def attr_pages(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    html = F.concat(F.lit('<img alt="'), p.p_name, F.lit('" title=" '), p.p_brand,
                    F.lit(' "><input placeholder="'), p.p_type, F.lit('">'))
    return p.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


ATTR_PAGES_SQL = ("(SELECT p_partkey AS page_id, '<img alt=\"' || p_name || '\" title=\" ' || p_brand || "
                  "' \"><input placeholder=\"' || p_type || '\">' AS html FROM part)")


def script_pages(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    html = F.concat(F.lit('<script>var a={"text":"'), c.c_name, F.lit('","title" :"'), c.c_mktsegment,
                    F.lit('","name":"'), c.c_mktsegment, F.lit('"};</script>'))
    return c.select(F.col("c_custkey").alias("page_id"), html.alias("html"))


SCRIPT_PAGES_SQL = ("(SELECT c_custkey AS page_id, '<script>var a={\"text\":\"' || c_name || '\",\"title\" :\"' || "
                    "c_mktsegment || '\",\"name\":\"' || c_mktsegment || '\"};</script>' AS html FROM customer)")


def iframe_pages(spark, sf_dir) -> DataFrame:
    """Base64 data-URI iframes; every fifth customer gets a cut (invalid) payload."""
    b64 = "replace(base64(encode(concat('<p>Customer ', c_name, '</p><b>From ', initcap(c_mktsegment), ' Street</b>'), 'UTF-8')), '\\r\\n', '')"
    cut = f"substring({b64}, CASE WHEN c_custkey % 5 = 4 THEN 2 ELSE 1 END)"
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as long) AS page_id", f"""concat('<iframe src="data:text/html;base64,', {cut}, '"></iframe>') AS html""")


IFRAME_PAGES_SQL = """(SELECT CAST(c_custkey AS BIGINT) AS page_id, '<iframe src="data:text/html;base64,' ||
  substr(to_base64(encode('<p>Customer ' || c_name || '</p><b>From ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Street</b>')),
    CASE WHEN c_custkey % 5 = 4 THEN 2 ELSE 1 END) || '"></iframe>' AS html FROM customer)"""


# One page of a document: elements whose content is not markup, references of all
# kinds, nested templates, and, by id, one element that is open at the page's end
# and holds the whole text.  ``LINE`` is the text's first line.
CONTENT_PARTS = (
    "<title>A <b>&notit; ", "LINE", "</title x>",
    '<textarea title="&copy=1 &copy; x &lt">x</p>&eacute ', "LINE", "</TEXTAREA >",
    "<noscript><p>No &amp; script ", "LINE", "</p></noscript>",
    '<template title="tpl"><p title="inner">', "LINE", "<template>deep</template> more</p><script>var s=\"in template\";</script></template></template>",
    "<p>After &check; it&#146;s &#x80; &#0; &#xD800; &AMP &bogus; AT&T ", "LINE", "</p>",
    '<iframe title="frame"><b>fallback ', "LINE", "</b></iframe><xmp><u>raw &amp; ", "LINE", "</u></xmp>",
    "<!--><p>Seen &CounterClockwiseContourIntegral; &NotEqualTilde; x</p></ bogus ><noframes>a</noframe></noframes>",
)
CONTENT_OPEN_ENDS = ('<script>var a = "', "<style>", "<textarea>", "<template><p>", "<!-- ", "<plaintext><b>", "<noembed>", "<p>")
CONTENT_CUT = "<a href="  # a tag cut off at the page's end


def content_pages(spark, sf_dir) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL"), "doc_id")
    line = F.substring_index("text", "\n", 1)
    ends = F.element_at(F.array(*[F.lit(e) for e in CONTENT_OPEN_ENDS]), (F.pmod("doc_id", F.lit(len(CONTENT_OPEN_ENDS))) + 1).cast("int"))
    html = F.concat(*[line if p == "LINE" else F.lit(p) for p in CONTENT_PARTS], ends, F.col("text"), F.lit(CONTENT_CUT))
    return d.select(F.col("doc_id").alias("page_id"), html.alias("html"))


def _sql_quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CONTENT_PAGES_SQL = ("(SELECT doc_id AS page_id, " + " || ".join("split_part(text, chr(10), 1)" if p == "LINE" else _sql_quoted(p) for p in CONTENT_PARTS)
                     + " || ([" + ", ".join(map(_sql_quoted, CONTENT_OPEN_ENDS)) + "])[doc_id % 8 + 1] || text || "
                     + _sql_quoted(CONTENT_CUT) + " AS html FROM documents WHERE doc_id IS NOT NULL)")


def bare_pages(spark, sf_dir) -> DataFrame:
    """Pages with nothing to translate (a comment and a one-digit paragraph)."""
    c = table(spark, sf_dir, "customer")
    html = F.concat(F.lit("<html><body><!-- "), c.c_name, F.lit(" --><p>"), (c.c_custkey % 10).cast("string"),
                    F.lit("</p></body></html>"))
    return c.select((F.col("c_custkey").cast("long") * SETS + BARE_SET).alias("page_id"), html.alias("html"))


BARE_PAGES_SQL = (f"(SELECT CAST(c_custkey AS BIGINT) * {SETS} + {BARE_SET} AS page_id, '<html><body><!-- ' || c_name || "
                  "' --><p>' || CAST(c_custkey % 10 AS VARCHAR) || '</p></body></html>' AS html FROM customer)")


def mixed_pages(spark, sf_dir) -> DataFrame:
    shift = lambda df, k: df.select((F.col("page_id") * SETS + k).alias("page_id"), "html")
    return (shift(table(spark, sf_dir, "pages"), PAGES_SET)
            .unionByName(shift(attr_pages(spark, sf_dir), ATTR_SET))
            .unionByName(shift(script_pages(spark, sf_dir), SCRIPT_SET))
            .unionByName(shift(iframe_pages(spark, sf_dir), IFRAME_SET)))


MIXED_PAGES_SQL = (f"(SELECT page_id * {SETS} AS page_id, html FROM pages UNION ALL "
                   f"SELECT page_id * {SETS} + {ATTR_SET}, html FROM {ATTR_PAGES_SQL} UNION ALL "
                   f"SELECT page_id * {SETS} + {SCRIPT_SET}, html FROM {SCRIPT_PAGES_SQL} UNION ALL "
                   f"SELECT page_id * {SETS} + {IFRAME_SET}, html FROM {IFRAME_PAGES_SQL})")


# --- locations -------------------------------------------------------------------------

# URLs and other inputs made of a page's id (ID) and the rest of its URL after the scheme (REST)
LOCATION_SHAPES = (
    ("REST",), ("pages/", "ID", ".html"), ("/srv/", "ID", ".htm"), ("HTTPS://", "REST"), ("ftp://", "REST"),
    ("https://Ex.COM/caf\u00e9/", "ID", " m\u00fcnchen \u4e2d\U0001F600.html?x=1"), ("http://h.org/a/b/../c/./", "ID", "/.."),
    ("http://[2001:DB8:0:0:0:00:0:", "ID", "]:8080/v6/", "ID", ".x.html"), ("http://[::", "ID", "]/"), ("http://[1:2::3::", "ID", "]/"),
    ("http://user:p@ss@Host.net:80\\back\\", "ID", "%2e%2e/{x}|\"y\".htm#f"), (" HTTPS:example.org/%2E/%2e.", "ID", "\t/x\n "),
    ("http://bad host/", "ID"), ("http://h%2Eorg/%41", "ID", "%zz"), ("http://h.org:99999/", "ID"), ("http://h.org:0080/../../", "ID", "/%2E%2e"),
    ("http:///p", "ID", "/q+r~s^t|u"), ("http://?q", "ID"), ("https://", "ID", "<.org/"), ("http://h.org",), ("http://h.org?x=/y/z", "ID"),
)


def location_inputs(spark, sf_dir) -> DataFrame:
    """``(page_id, variant, input)``: every page's URL in all LOCATION_SHAPES."""
    p = table(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", "^[A-Za-z]+://(.*)$", 1)
    part = {"ID": F.col("page_id").cast("string"), "REST": rest}
    shapes = [F.col("url") if s == ("REST",) else F.concat(*[part.get(x, F.lit(x)) for x in s]) for s in LOCATION_SHAPES]
    return p.select("page_id", F.posexplode(F.array(*shapes)).alias("variant", "input"))


LOCATION_INPUTS_SQL = (
    "(SELECT page_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS variant, unnest(v) AS input FROM (SELECT page_id, ["
    + ", ".join("url" if s == ("REST",) else " || ".join({"ID": "CAST(page_id AS VARCHAR)", "REST": "regexp_extract(url, '^[A-Za-z]+://(.*)$', 1)"}.get(x, _sql_quoted(x))
                                                         for x in s) for s in LOCATION_SHAPES) + "] AS v FROM pages))")


# Pages with resources of all kinds; every seventh is NULL.
RESOURCE_PARTS = ('<link rel="Stylesheet alternate" href="a.css"><link rel="icon" href="i.png"><style>p{}</style><p onclick="x()" STYLE=\'a\' title="', "NAME",
                  '" Onload=y>', "NAME", '<img src="a.png" alt="', "NAME", '" srcset=b.png><script src="s.js">var a="', "NAME",
                  '";</script></p><picture><source srcset="c"></picture><video src="v" style="w">', "NAME", "</video><style>q{}")


def resource_pages(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    html = F.concat(*[p.p_name if x == "NAME" else F.lit(x) for x in RESOURCE_PARTS])
    return p.select(F.col("p_partkey").cast("long").alias("page_id"), F.when(F.col("p_partkey") % 7 != 0, html).alias("html"))


RESOURCE_PAGES_SQL = ("(SELECT CAST(p_partkey AS BIGINT) AS page_id, CASE WHEN p_partkey % 7 <> 0 THEN "
                      + " || ".join("p_name" if x == "NAME" else _sql_quoted(x) for x in RESOURCE_PARTS) + " END AS html FROM part)")


# --- response bodies and marker texts ----------------------------------------------------

def response_bodies(spark, sf_dir) -> DataFrame:
    """Eight body shapes chosen by ``event_id % 8`` (JSON keys, null/number values, not JSON)."""
    e = table(spark, sf_dir, "events")
    k = (e.event_id % 7).cast("string")
    line = F.concat(F.lit("["), k, F.lit("] "), e.event_type)
    shape = e.event_id % 8
    body = (
        F.when(shape == 0, F.concat(F.lit('{"data":"'), line, F.lit('"}')))
        .when(shape == 1, F.concat(F.lit('{"text":"'), line, F.lit('"}')))
        .when(shape == 2, F.concat(F.lit('{"result":"'), line, F.lit('"}')))
        .when(shape == 3, F.concat(F.lit('{"data":null,"text":"'), line, F.lit('"}')))
        .when(shape == 4, F.concat(F.lit('{"data":'), (e.event_id % 10).cast("string"), F.lit(',"text":"'), line,
                                   F.lit('"}')))
        .when(shape == 5, F.concat(F.lit('{"x":'), e.user_id.cast("string"), F.lit("}")))
        .when(shape == 6, line)
        .otherwise(F.concat(F.lit('{"data":"'), line, F.lit('"} zz')))
    )
    return e.select("event_id", body.alias("body"))


RESPONSE_BODIES_SQL = """(SELECT event_id, CASE event_id % 8
    WHEN 0 THEN '{"data":"' || line || '"}'
    WHEN 1 THEN '{"text":"' || line || '"}'
    WHEN 2 THEN '{"result":"' || line || '"}'
    WHEN 3 THEN '{"data":null,"text":"' || line || '"}'
    WHEN 4 THEN '{"data":' || CAST(event_id % 10 AS VARCHAR) || ',"text":"' || line || '"}'
    WHEN 5 THEN '{"x":' || CAST(user_id AS VARCHAR) || '}'
    WHEN 6 THEN line
    ELSE '{"data":"' || line || '"} zz' END AS body
  FROM (SELECT event_id, user_id, '[' || CAST(event_id % 7 AS VARCHAR) || '] ' || event_type AS line FROM events))"""

OUT_OF_RANGE_LINE = "[999999] out of range"
OVERFLOW_LINE = "[99999999999999999999] overflow"


def marker_responses(spark, sf_dir) -> DataFrame:
    """``(doc_id, batch_idx, text)``: each document line as ``[line % 3] line`` (repeats),
    plus an out-of-range and an overflowing marker line."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    lines = F.transform(F.split(d.text, "\n", -1),
                        lambda x, i: F.concat(F.lit("["), (i % 3).cast("string"), F.lit("] "), x))
    txt = F.concat(F.array_join(lines, "\n"), F.lit("\n" + OUT_OF_RANGE_LINE + "\n" + OVERFLOW_LINE))
    return d.select("doc_id", F.lit(0).cast("long").alias("batch_idx"), txt.alias("text"))


MARKER_RESPONSES_SQL = (
    "(SELECT doc_id, CAST(0 AS BIGINT) AS batch_idx, array_to_string(list_transform(string_split(text, chr(10)), "
    "lambda x, i: '[' || CAST((i - 1) % 3 AS VARCHAR) || '] ' || x), chr(10)) || chr(10) || "
    f"'{OUT_OF_RANGE_LINE}' || chr(10) || '{OVERFLOW_LINE}' AS text FROM documents)"
)


def doc_lines(spark, sf_dir, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    """Every line of every text: ``(id, seq, line)`` with the raw line."""
    d = spread(table(spark, sf_dir, name), id_col)
    return d.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "line")) \
        .withColumn("seq", F.col("seq").cast("long"))


def doc_lines_sql(name: str = "documents", id_col: str = "doc_id") -> str:
    return (f"(SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS seq, unnest(ls) AS line FROM "
            f"(SELECT {id_col} AS doc_id, string_split(text, chr(10)) AS ls FROM {name}))")
