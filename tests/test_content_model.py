"""Elements without markup inside, templates, cut-off pages, character references."""

import html
import html.entities

from pyspark.sql import functions as F

from babelfold.functions import text as T
from babelfold.operators import segments as S
from babelfold.operators import tokens as TK
from babelfold.operators import translate as TR
from babelfold.plans.pipeline import translate_pages
from support import one_col


def pages_df(spark, pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


def tokens_of(spark, page):
    rows = TK.tokenize(TK.partition_pages(pages_df(spark, [page]))).orderBy("pos").collect()
    assert "".join(r.raw for r in rows) == page
    return [(r.kind, r.tag, r.raw) for r in rows]


# page -> (kind, tag, raw) of its tokens
GOLDEN = {
    "<textarea>a <b> &lt; c</textarea>d": [("open", "textarea", "<textarea>"), ("text", None, "a <b> &lt; c"), ("close", "textarea", "</textarea>"),
                                           ("text", None, "d")],
    "<title>x<i>y</title z>": [("open", "title", "<title>"), ("text", None, "x<i>y"), ("close", "title", "</title z>")],
    "<noscript><p>n</p></noscript>": [("open", "noscript", "<noscript>"), ("rawtext", "noscript", "<p>n</p>"), ("close", "noscript", "</noscript>")],
    "<iframe src=a><b>f</b></iframe>": [("open", "iframe", "<iframe src=a>"), ("rawtext", "iframe", "<b>f</b>"), ("close", "iframe", "</iframe>")],
    "<xmp><u>&amp;</u></XMP\n>": [("open", "xmp", "<xmp>"), ("rawtext", "xmp", "<u>&amp;</u>"), ("close", "xmp", "</XMP\n>")],
    "<p>a</p><script>var a = '<b>x'; </p>": [("open", "p", "<p>"), ("text", None, "a"), ("close", "p", "</p>"), ("open", "script", "<script>"),
                                             ("rawtext", "script", "var a = '<b>x'; </p>")],
    "<textarea>x</b>": [("open", "textarea", "<textarea>"), ("text", None, "x</b>")],
    "a<plaintext>b</plaintext><i>": [("text", None, "a"), ("open", "plaintext", "<plaintext>"), ("rawtext", "plaintext", "b</plaintext><i>")],
    "<scripty>a</scripty>": [("open", "scripty", "<scripty>"), ("text", None, "a"), ("close", "scripty", "</scripty>")],
    "<template><p>a<template>b</template>c</p></template>d": [
        ("open", "template", "<template>"), ("unvisited", None, "<p>"), ("unvisited", None, "a"), ("unvisited", None, "<template>"), ("unvisited", None, "b"),
        ("unvisited", None, "</template>"), ("unvisited", None, "c"), ("unvisited", None, "</p>"), ("close", "template", "</template>"), ("text", None, "d")],
    "</template>a<template>b<script>c</script>": [
        ("close", "template", "</template>"), ("text", None, "a"), ("open", "template", "<template>"), ("unvisited", None, "b"),
        ("unvisited", None, "<script>"), ("unvisited", None, "c"), ("unvisited", None, "</script>")],
    "a<!-->b<!--->c<!-- d --!>e<!-- f": [("text", None, "a"), ("comment", None, "<!-->"), ("text", None, "b"), ("comment", None, "<!--->"),
                                         ("text", None, "c"), ("comment", None, "<!-- d --!>"), ("text", None, "e"), ("comment", None, "<!-- f")],
    "a</>b</ c>d<?e>f<a href=": [("text", None, "a"), ("decl", None, "</>"), ("text", None, "b"), ("decl", None, "</ c>"), ("text", None, "d"),
                                 ("decl", None, "<?e>"), ("text", None, "f"), ("decl", None, "<a href=")],
    "<template": [("decl", None, "<template")],
    "1 < 2 <3": [("text", None, "1 < 2 <3")],
}


def test_content_model_golden(spark):
    for page, want in GOLDEN.items():
        assert tokens_of(spark, page) == want, page


def test_only_visited_text_is_taken_and_written(spark):
    page = ("<title>Tom &amp; <b></title><template title='Outer note'><p title='inner note'>hidden text</p></template>"
            "<noscript><p>No script</p></noscript><textarea>Type <i>here</i></textarea><p>Last words</p>")
    tok = TK.tokenize(TK.partition_pages(pages_df(spark, [page])))
    segs = {(r.kind, r.text) for r in S.extract_segments(tok).collect()}
    assert segs == {("text", "Tom & <b>"), ("attr", "Outer note"), ("text", "<p>No script</p>"), ("text", "Type <i>here</i>"), ("text", "Last words")}
    out = translate_pages(pages_df(spark, [page])).pages.first().html
    assert out == ("<title>zh:Tom &amp; &lt;b&gt;</title><template title=\"zh:Outer note\"><p title='inner note'>hidden text</p></template>"
                   "<noscript>zh:<p>No script</p></noscript><textarea>zh:Type &lt;i&gt;here&lt;/i&gt;</textarea><p>zh:Last words</p>")


def test_many_elements_do_not_overflow(spark):
    page = "<textarea>" + "<b>x " * 200_000 + "</textarea>" + "<a " * 100_000
    rows = tokens_of(spark, page)
    assert [r[0] for r in rows] == ["open", "text", "close", "decl"]
    deep = "<template>" * 2000 + "x" + "</template>" * 2000
    assert {r[0] for r in tokens_of(spark, deep)[1:-1]} == {"unvisited"}


def test_every_entity_name_as_the_standard_library(spark):
    names = list(html.entities.html5)
    cases = [f"a &{n} b" for n in names] + [f"&{n}x1;" for n in names] + [f"&{n}&{n}=" for n in names]
    got = {r.v: r.d for r in one_col(spark, cases).select("v", T.decode_entities("v").alias("d")).collect()}
    assert {v for v in cases if got[v] != html.unescape(v)} == set()


def test_numeric_references(spark):
    cases = {"&#65;": "A", "&#65": "A", "&#x41 b": "A b", "&#X3b;": ";", "&#146;": "’", "&#x80;x": "€x", "&#129;": "\x81", "&#0;": "�",
             "&#xD800;": "�", "&#1114112;": "�", "&#99999999999999999999;": "�", "&#0000000000000000000065;": "A",
             "&#x110000;": "�", "&#x1F600;": "😀", "&#;": "&#;", "&#x;": "&#x;", "&#xg": "&#xg", "&": "&", "a&b": "a&b", "&&amp;&": "&&&"}
    got = {r.v: r.d for r in one_col(spark, list(cases)).select("v", T.decode_entities("v").alias("d")).collect()}
    assert got == cases


def test_old_names_in_attributes(spark):
    cases = {"&copy=1": "&copy=1", "&copy 1": "© 1", "&copyx": "&copyx", "&copy": "©", "&copy;=": "©=", "?a=b&lt=c&amp;d": "?a=b&lt=c&d",
             "&notin;": "∉", "&notit;": "&notit;", "&not": "¬"}
    got = {r.v: r.d for r in one_col(spark, list(cases)).select("v", F.expr(T.sql_decode("v", attr=True)).alias("d")).collect()}
    assert got == cases


def test_identity_keeps_the_meaning_of_references(spark):
    page = "<p>it&#146;s &check; Done &copy 2024 AT&T</p><a title='x&copy=1 &NotEqualTilde;'>y</a>"
    out = translate_pages(pages_df(spark, [page]), translator=TR.identity()).pages.first().html
    assert out == "<p>it’s ✓ Done © 2024 AT&amp;T</p><a title=\"x&amp;copy=1 ≂̸\">y</a>"


def test_long_phrase_in_an_iframe(spark):
    import base64
    src = base64.b64encode(("<p>" + "Word " * 50_000 + "</p>").encode()).decode()
    tok = TK.tokenize(TK.partition_pages(pages_df(spark, [f'<iframe src="data:text/html;base64,{src}"></iframe>'])))
    got = S.extract_segments(tok, "repaired").collect()
    assert [(r.kind, r.text) for r in got] == [("iframe_text", ("Word " * 50_000).strip())]


def test_resource_switches(spark):
    from babelfold.operators.resources import strip_resources

    page = "<style>a</style><p onclick='f()' style=x title=t>b<img src=i alt=c><script>d</script><link rel=stylesheet href=e><a href='javascript:x'>z</a>"
    tok = TK.tokenize(TK.partition_pages(pages_df(spark, [page, None, ""])))
    want = {
        (True, True, True): page,
        (True, False, True): "<style>a</style><p style=x title=t>b<img src=i alt=c><link rel=stylesheet href=e><a href='javascript:x'>z</a>",
        (False, True, True): "<p onclick='f()' title=t>b<img src=i alt=c><script>d</script><a href='javascript:x'>z</a>",
        (True, True, False): page.replace(" src=i", ""),
        (False, False, False): "<p title=t>b<img alt=c><a href='javascript:x'>z</a>",
    }
    for (css, js, images), html in want.items():
        got = {r.page_id: r.html for r in strip_resources(tok, css, js, images).collect()}
        assert got == {0: html, 1: None, 2: ""}


def test_each_pass_takes_a_page_apart_once(spark):
    """No filter repeats the work of the tokens' array below its projection."""
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, ""), (3, None), (4, "x < y & <b title='t'>z")], "page_id long, html string")
    t = TK.tokenize(TK.partition_pages(pages))
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Filter") and "regexp_extract_all" in x]
    got = {r.page_id: r.raw for r in t.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "").alias("raw")).collect()}
    assert got == {1: "<p>a</p>", 2: "", 3: "", 4: "x < y & <b title='t'>z"}
