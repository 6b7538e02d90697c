"""Tokens, extraction and the end-to-end pipeline: properties and small pages."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from babelfold.functions import text as T
from babelfold.operators import segments as S
from babelfold.operators import tokens as TK
from babelfold.operators import translate as TR
from babelfold.plans.pipeline import translate_pages
from support import SF_SMALL

PAGE = """<!DOCTYPE html>
<html lang="en"><head><title>Test Page</title></head>
<body>
  <h1>Hello World</h1>
  <p>Welcome to our <strong>site</strong> &amp; more.</p>
  <img src="a.png" alt="A picture" title="--"><input placeholder="Your name">
  <script>var t = "Click here"; var cfg = {"title":"Main menu"};</script>
  <style>p{margin:0}</style>
  <ul><li>One</li><li>Two</li><li>One</li></ul>
</body></html>"""


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "page_id long, html string")


def test_tokens_round_trip_and_parity(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    tok = TK.tokenize(TK.partition_pages(pages.select("page_id", "html")))
    joined = tok.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "")
        .alias("h"))
    assert joined.join(pages, "page_id").filter(F.col("h") != F.col("html")).count() == 0
    # decoded text sets equal Python's html.parser (script/style bodies excluded)
    texts = {}
    for r in tok.filter(F.col("kind") == "text").select("page_id", T.decode_entities("raw").alias("t")).collect():
        texts.setdefault(r.page_id, []).append(r.t)

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, d):
            if not self.skip:
                self.out.append(d)

    for r in pages.collect():
        p = P()
        p.feed(r.html)
        p.close()
        assert "".join(p.out) == "".join(texts.get(r.page_id, []))


def test_extraction_kinds_and_order(spark):
    tok = TK.tokenize(TK.partition_pages(pages_df(spark, [(1, PAGE)])))
    segs = S.extract_segments(tok).orderBy("seq").collect()
    texts = [s.text for s in segs]
    assert [s.seq for s in segs] == list(range(len(segs)))
    assert len(texts) == len(set(texts))
    for t in ("Test Page", "Hello World", "A picture", "--", "Your name", "Click here", "Main menu", "p{margin:0}",
              "One", "Two", "site"):
        assert t in texts, t
    assert "Welcome to our" in texts and "& more." in texts
    kinds = {s.text: s.kind for s in segs}
    assert kinds["A picture"] == "attr" and kinds["Click here"] == "js_string" and kinds["Hello World"] == "text"
    # breadth-first: the title (depth 3) comes before the list items (depth 4+)
    assert texts.index("Test Page") < texts.index("One")


def test_attribute_quoting_forms(spark):
    html = """<a title="a=b" alt='x "y"' placeholder=zz/><img alt="first" ALT="second"><p title=" ">t</p>"""
    tok = TK.tokenize(TK.partition_pages(pages_df(spark, [(1, html)])))
    got = {(s.attr, s.text) for s in S.extract_segments(tok).collect() if s.kind == "attr"}
    assert got == {("title", "a=b"), ("alt", 'x "y"'), ("placeholder", "zz/"), ("alt", "first")}


def test_iframe_modes(spark):
    import base64
    good = base64.b64encode(b"<p>Hello Iframe World</p>").decode()
    html = f'<iframe src="data:text/html;base64,{good}"></iframe><iframe src="data:text/html;base64,{good[1:]}"></iframe>'
    tok = TK.tokenize(TK.partition_pages(pages_df(spark, [(1, html)])))
    assert S.extract_segments(tok, "off").count() == 0
    rep = {(r.kind, r.text) for r in S.extract_segments(tok, "repaired").collect()}
    assert ("iframe_text", "Hello Iframe World") in rep


def test_prefix_pipeline_and_attrs(spark):
    r = translate_pages(pages_df(spark, [(1, PAGE), (2, "<html><body><!-- c --><p>7</p></body></html>")]))
    out = {x.page_id: x for x in r.pages.collect()}
    h = out[1].html
    assert "<title>zh:Test Page</title>" in h and "<h1>zh:Hello World</h1>" in h
    assert 'alt="zh:A picture"' in h and 'placeholder="zh:Your name"' in h and 'title="zh:--"' in h
    assert "<li>zh:One</li><li>zh:Two</li><li>zh:One</li>" in h
    assert 'var t = "Click here"' in h  # script strings are extracted, never written back
    assert "<style>zh:p{margin:0}</style>" in h
    assert "zh:&amp; more." in h
    assert out[2].html == "<html><body><!-- c --><p>7</p></body></html>" and out[2].n_applied == 0
    r.unpersist()


def test_identity_keeps_single_line_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    r = translate_pages(pages, translator=TR.identity())
    # identity translation re-writes each text node as its trimmed, re-escaped self
    tok = r.tokens.filter(F.col("kind") == "text")
    untrimmed = tok.filter(T.trim_ws("raw") != F.col("raw")).select("page_id").distinct()
    escaped = tok.filter(F.col("raw").contains("&")).select("page_id").distinct()
    same = r.pages.join(pages.select("page_id", F.col("html").alias("h0")), "page_id")
    changed = same.filter(F.col("html") != F.col("h0")).select("page_id")
    assert changed.subtract(untrimmed.union(escaped)).count() == 0
    r.unpersist()


def test_newline_marker_injection(spark):
    # segment 5 holds "one\n[0] two": its second line overwrites segment 0
    items = "".join(f"<p>w{i}</p>" for i in range(5)) + "<pre>one\n[0] two</pre>"
    r = translate_pages(pages_df(spark, [(1, items)]), translator=TR.identity())
    tr = {x.seq: x.translation for x in r.translations.collect()}
    assert tr[0] == "two" and tr[5] == "one"
    r.unpersist()


def test_python_translator_and_failures(spark):
    r = translate_pages(pages_df(spark, [(1, PAGE)]), translator=TR.python_prefix("ja", fail_over_bytes=10))
    resp = r.responses.collect()
    assert resp and all(x.error_class == "api" for x in resp)
    assert r.pages.first().html == PAGE  # all batches failed: page unchanged
    ok = translate_pages(pages_df(spark, [(1, PAGE)]), translator=TR.python_prefix("ja"))
    assert "<h1>ja:Hello World</h1>" in ok.pages.first().html


def test_oversized_page_passes_through(spark):
    r = translate_pages(pages_df(spark, [(1, PAGE)]), max_page_bytes=10)
    assert r.pages.first().html == PAGE
    assert r.rejected.first().error_class == "input"


def test_empty_and_null_pages_pass_through(spark):
    r = translate_pages(pages_df(spark, [(1, ""), (2, None), (3, "<p>Hi there</p>")]))
    out = {x.page_id: x.html for x in r.pages.collect()}
    assert out == {1: "", 2: None, 3: "<p>zh:Hi there</p>"}


def test_many_bare_lt_do_not_overflow(spark):
    html = "<p>" + "a < b " * 200000 + "</p>"
    tok = TK.tokenize(TK.partition_pages(pages_df(spark, [(1, html)])))
    rows = tok.orderBy("pos").collect()
    assert [r.kind for r in rows] == ["open", "text", "close"] and rows[1].raw == "a < b " * 200000


def test_memory_second_run_sends_nothing(spark):
    from babelfold.operators import memory as MEM
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").filter("page_id < 10")
    first = translate_pages(pages)
    mem = first.tmap.select(F.lit("zh").alias("lang"), "text", "translation", F.lit(1).cast("long").alias("run_ts"))
    mem = MEM.tm_merge(mem.limit(0), mem)  # one entry per text
    second = translate_pages(pages, memory=mem)
    assert second.batches.count() == 0
    a = {r.page_id: r.html for r in first.pages.collect()}
    b = {r.page_id: r.html for r in second.pages.collect()}
    assert a == b
    # half a memory: only the misses are sent, output unchanged
    half = mem.filter(F.length("text") % 2 == 0)
    third = translate_pages(pages, memory=half)
    assert 0 < third.batches.count()
    assert {r.page_id: r.html for r in third.pages.collect()} == a


def test_no_page_is_lost_or_left_out_for_its_size(spark):
    big = "<p>Hello World</p>" + "<b>x1</b>" * 200_000
    out = translate_pages(pages_df(spark, [(None, "<p>Hello World</p>"), (1, big)])).pages.collect()
    assert len(out) == 2
    assert {r.page_id: "zh:Hello World" in r.html for r in out} == {None: False, 1: True}


def test_quoted_angle_bracket_does_not_end_a_tag(spark):
    from babelfold.operators.tokens import partition_pages, tokenize

    for html in ('<img alt="a > b picture" src="z.png">Hello', "<a title=it's x='>'>Hi</a>", '<p title="open>text</p>',
                 '<script data-x="a>b">var a=1;</script>Hi', "<i " + " ".join(f'a{i}="{i}>"' for i in range(20_000)) + ">Hi</i>"):
        rows = tokenize(partition_pages(pages_df(spark, [(1, html)]))).orderBy("pos").collect()
        assert "".join(r.raw for r in rows) == html
        assert [r.raw for r in rows if r.kind == "text"][-1] in ("Hello", "Hi", "text")
    one = tokenize(partition_pages(pages_df(spark, [(1, '<img alt="a > b picture" src="z.png">Hello')]))).collect()
    assert [(r.kind, r.tag) for r in sorted(one, key=lambda r: r.pos)] == [("open", "img"), ("text", None)]


def test_memory_with_two_entries_and_null_pages(spark):
    from babelfold.operators import memory as MEM

    mem = spark.createDataFrame([("zh", "Hello", "old", 1), ("zh", "Hello", "new", 2)], "lang string, text string, translation string, run_ts long")
    seg = spark.createDataFrame([(1, 0, "Hello")], "doc_id long, seq long, text string")
    assert [r.translation for r in MEM.tm_split(seg, mem, "zh").collect()] == ["new"]
    p = spark.createDataFrame([(1, None), (2, None), (3, "x")], "page_id long, html string")
    assert {r.page_id: r.rep_id for r in MEM.dedup_pages(p).collect()} == {1: 1, 2: 1, 3: 3}


def test_translator_errors_have_classes(spark):
    def fn(payload):
        raise TimeoutError("late") if "Hello" in payload else ValueError("x")
    assert translate_pages(pages_df(spark, [(1, "<p>Hello World</p>")]), translator=fn).responses.first().error_class == "network"
    assert translate_pages(pages_df(spark, [(1, "<p>Hello World</p>")]), translator=lambda p: {"a": 1}).responses.first().error_class == "parse"
