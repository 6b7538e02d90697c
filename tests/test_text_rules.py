"""Golden cases for the string rules (bytes, Unicode trim, predicates, entities)."""

import html

from pyspark.sql import functions as F

from babelfold.functions import text as T
from support import one_col

NBSP = " "

# value -> (text-node rule, script-string rule)
GOLDEN = {
    "a": (False, False),
    "中": (True, True),
    "42": (True, False),
    "2024": (True, False),
    "--- !": (False, False),
    "</p>": (True, True),
    "http status": (True, False),
    "a function": (True, False),
    "var x": (True, False),
    " ".join(["w"] * 11): (True, False),
    "x" * 200: (True, False),
    "abc": (True, True),
}


def test_predicates_golden(spark):
    df = one_col(spark, list(GOLDEN)).select(
        "v", T.is_text_node_kept(T.trim_ws("v")).alias("t"), T.is_translatable(T.trim_ws("v")).alias("j"))
    got = {r.v: (r.t, r.j) for r in df.collect()}
    assert got == GOLDEN


def test_unicode_trim_and_bytes(spark):
    v = NBSP + "ok" + NBSP
    r = one_col(spark, [v]).select(T.trim_ws("v").alias("t"), T.byte_len(T.trim_ws("v")).alias("n"),
                                   T.is_text_node_kept(T.trim_ws("v")).alias("k"),
                                   T.is_translatable(T.trim_ws("v")).alias("j")).first()
    assert (r.t, r.n, r.k, r.j) == ("ok", 2, True, False)


def test_attr_rule_keeps_punctuation(spark):
    r = one_col(spark, ["--", "x", "  "]).select("v", T.is_attr_kept(T.trim_ws("v")).alias("k")).collect()
    assert {x.v: x.k for x in r} == {"--": True, "x": False, "  ": False}


def test_word_count(spark):
    r = one_col(spark, ["", "  a  b　c ", "one"]).select("v", T.word_count("v").alias("n")).collect()
    assert {x.v: x.n for x in r} == {"": 0, "  a  b　c ": 3, "one": 1}


def test_entities_match_python(spark):
    cases = ["a &amp; b", "&copy; x &middot; y", "&lt;p&gt;", "&#20013;&#x4E2D;", "&bogus; &", "&#0;", "a&b",
             "&quot;q&quot;", "&nbsp;x", "&eacute;t&eacute;"]
    got = [r.d for r in one_col(spark, cases).select(T.decode_entities("v").alias("d")).collect()]
    # html.unescape is the reference for every case except NUL (HTML5 -> U+FFFD)
    want = [html.unescape(c) if c != "&#0;" else "�" for c in cases]
    assert got == want


def test_escape(spark):
    r = one_col(spark, ['a<b>&"' + NBSP]).select(T.escape_text("v").alias("t"), T.escape_attr("v").alias("a")).first()
    assert r.t == 'a&lt;b&gt;&amp;"&nbsp;'
    assert r.a == "a<b>&amp;&quot;&nbsp;"


def test_fold_ws(spark):
    r = one_col(spark, ["a\n\n b\tc"]).select(T.fold_ws("v").alias("f")).first()
    assert r.f == "a b c"


def test_no_python_udf_in_rules(spark):
    df = one_col(spark, ["x"]).select(T.is_translatable(T.trim_ws(T.decode_entities("v"))).alias("k"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert F is not None
