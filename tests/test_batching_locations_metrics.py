"""Batch sizes, request body, location columns and metric rules (golden cases)."""

import json

import pytest
from pyspark.sql import functions as F

from babelfold.functions import urls as U
from babelfold.operators import batching as B
from babelfold.operators import metrics as M
from support import one_col


@pytest.mark.parametrize("n,c,size,batches", [(1, 5, 5, 1), (5, 5, 5, 1), (27, 5, 5, 6), (50, 5, 10, 5),
                                              (53, 5, 10, 6), (12, 0, 12, 1)])
def test_batch_plan(spark, n, c, size, batches):
    segs = spark.createDataFrame([(1, i, f"t{i}") for i in range(n)], "page_id long, seq long, text string")
    p = B.plan_batches(segs, concurrent=c)
    rows = p.select("batch_size", "batch_idx").distinct().collect()
    assert {r.batch_size for r in rows} == {size}
    assert len({r.batch_idx for r in rows}) == batches


def test_payload_and_request(spark):
    segs = spark.createDataFrame([(1, 0, "one\ntwo"), (1, 1, " x ")], "page_id long, seq long, text string")
    b = B.build_payload(B.plan_batches(segs)).first()
    assert b.payload == "[0] one\ntwo\n[1] x" and b.n == 2 and b.n_items == 2
    esc = B.build_payload(B.plan_batches(segs), escape_newlines=True).first()
    assert esc.payload == "[0] one two\n[1] x"
    body = spark.range(1).select(B.request_json(F.lit(b.payload), "ja").alias("j")).first().j
    assert json.loads(body) == {"text": b.payload, "source_lang": "auto", "target_lang": "ja"}


def test_output_names(spark):
    urls = {"https://ex.com": "ex.com_index_zh.html", "https://ex.com/a/b.html?x=1": "ex.com_b_zh.html",
            "https://ex.com/a/b/": "ex.com_b_zh.html", "https://EX.com/a%20b": "ex.com_a_20b_zh.html"}
    got = {r.v: r.o for r in one_col(spark, list(urls)).select("v", U.output_name_url("v", "zh").alias("o")).collect()}
    assert got == urls
    files = {"/d/in.html": "/d/in_zh.html", "/d/in": "/d/in_zh.", "in.htm": "in_zh.htm", "/d/a.tar.gz": "/d/a.tar_zh.gz"}
    got = {r.v: r.o for r in one_col(spark, list(files)).select("v", U.output_name_file("v", "zh").alias("o")).collect()}
    assert got == files


def test_crawl_names(spark):
    cases = {"https://example.com/": "example.com_index_1.html", "https://example.com/path/to/page":
             "example.com_path_to_page_1.html", "https://example.com/path:with<bad>chars?query=1":
             "example.com_path_with%3Cbad%3Echars_1.html"}  # a URL's path has < and > percent-encoded
    got = {r.v: r.o for r in one_col(spark, list(cases)).select("v", U.crawl_name("v", 1).alias("o")).collect()}
    assert got == cases
    for name in got.values():
        assert not any(ch in name for ch in "<>:?")


def test_url_checks(spark):
    vals = {"https://example.com": True, "http://test.org": True, "https://subdomain.example.com/path": True,
            "": False, "ftp://example.com": False, "example.com": False, "invalid-url": False, "HTTP://x.org": False}
    got = {r.v: r.ok for r in one_col(spark, list(vals)).select("v", U.is_http_url("v").alias("ok")).collect()}
    assert got == vals
    kinds = {r.v: r.k for r in one_col(spark, ["HTTP://x.org/a", "rel/p.html", "/abs/p"])
             .select("v", U.classify_source("v", "/base")["kind"].alias("k")).collect()}
    assert kinds == {"HTTP://x.org/a": "url", "rel/p.html": "file", "/abs/p": "file"}
    warn = {r.v: r.w for r in one_col(spark, ["a.html", "a.htm", "a.HTML", "a", "a.txt", ".hidden"])
            .select("v", U.ext_warning("v").alias("w")).collect()}
    assert warn == {"a.html": False, "a.htm": False, "a.HTML": True, "a": False, "a.txt": True, ".hidden": False}


def test_grades_and_durations(spark):
    ms = [0, 500, 501, 800, 801, 1000, 1001, 999, 1234]
    df = spark.createDataFrame([(m,) for m in ms], "ms long").select(
        "ms", M.perf_grade("ms").alias("g"), M.target_met("ms").alias("t"), M.format_duration("ms").alias("f"))
    got = {r.ms: (r.g, r.t, r.f) for r in df.collect()}
    assert got[500][0] == 1 and got[501][0] == 2 and got[800][0] == 2 and got[801][0] == 3
    assert got[1000] == (3, False, "1.000s") and got[1001][0] == 4
    assert got[999] == (1 + 2, True, "999ms")
    assert got[1234][2] == "1.234s"


def test_ratios(spark):
    r = spark.range(1).select(M.throughput_kbps(F.lit(2048), F.lit(0)).alias("z"),
                              M.throughput_kbps(F.lit(2048), F.lit(500)).alias("k"),
                              M.hit_rate(F.lit(0), F.lit(0)).alias("h0"), M.hit_rate(F.lit(3), F.lit(1)).alias("h"),
                              *M.size_metrics(F.lit(0), F.lit(10))).first()
    assert r.z is None and r.k == 4.0 and r.h0 is None and r.h == 0.75 and r.change_pct is None


def test_lang_guard(spark):
    got = {r.v: r.ok for r in one_col(spark, ["zh", "en", "xx", "ZH"]).select("v", B.lang_supported(F.col("v")).alias("ok")).collect()}
    assert got == {"zh": True, "en": True, "xx": False, "ZH": False}
    with pytest.raises(ValueError):
        B.request_json(F.lit("x"), "xx")


def test_job_totals(spark):
    cols = "page_id long, bytes_in long, bytes_out long, n_segments long, n_batches long, n_failed_batches long, " \
           "n_accepted long, n_applied long"
    per_page = spark.createDataFrame([(1, 10, 12, 3, 1, 0, 3, 3), (2, 5, 5, 0, 0, 0, 0, 0)], cols)
    r = M.job_totals(per_page).first()
    assert (r.n_pages, r.bytes_in, r.bytes_out, r.n_segments, r.n_applied) == (2, 15, 17, 3, 3)
