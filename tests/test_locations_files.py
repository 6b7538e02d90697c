"""URL rules, files under their output names, ids of files."""

import os

import pytest
from pyspark.sql import functions as F

from babelfold.functions import urls as U
from babelfold.sources import files as FILES
from babelfold.sources import pages as P
from support import one_col

# URL -> (host, path), by the URL standard
URLS = {
    "http://Example.COM": ("example.com", "/"),
    "https://example.com?x=/a": ("example.com", "/"),
    "  HTTPS:\\\\EX.com\\a\\b \n": ("ex.com", "/a/b"),
    "https:example.com/a": ("example.com", "/a"),
    "http:////example.com//a//": ("example.com", "//a//"),
    "http://u:p@w@h.org:8080/x": ("h.org", "/x"),
    "http://h.org:/x": ("h.org", "/x"),
    "http://h.org:65535/": ("h.org", "/"),
    "http://h.org:65536/": None,
    "http://h.org:8x/": None,
    "http://": None,
    "http://?a": None,
    "http://a b/": None,
    "http://a<b/": None,
    "http://h%41.org/%41": ("ha.org", "/%41"),
    "http://a%20b/": None,
    "http://h.org/a/./b/../c": ("h.org", "/a/c"),
    "http://h.org/../../a/..": ("h.org", "/"),
    "http://h.org/a/%2E%2e/b/%2e": ("h.org", "/b/"),
    "http://h.org/a/b/..": ("h.org", "/a/"),
    "http://h.org/...": ("h.org", "/..."),
    "http://h.org/café 中\U0001F600": ("h.org", "/caf%C3%A9%20%E4%B8%AD%F0%9F%98%80"),
    "http://h.org/{a}\"<b>`^|~+'": ("h.org", "/%7Ba%7D%22%3Cb%3E%60^|~+'"),
    "http://h.org/a\tb\nc": ("h.org", "/abc"),
    "http://h.org/%zz%": ("h.org", "/%zz%"),
    "http://[::1]:80/x": ("[::1]", "/x"),
    "http://[2001:DB8:0:0:1:0:0:1]/": ("[2001:db8::1:0:0:1]", "/"),
    "http://[0:0:0:0:0:0:0:0]/": ("[::]", "/"),
    "http://[1:2:3:4:5:6:7:8]/": ("[1:2:3:4:5:6:7:8]", "/"),
    "http://[1:0:0:0:0:0:0:0]/": ("[1::]", "/"),
    "http://[1:2]/": None,
    "http://[1::2::3]/": None,
    "http://[12345::]/": None,
    "http://[::1/": None,
    "ftp://h.org/": None,
    "a.html": None,
    "": None,
}


def test_url_parts(spark):
    u = U.parse_http_url("v")
    got = {r.v: (r.h, r.p) if r.h is not None else None for r in one_col(spark, list(URLS)).select("v", u["host"].alias("h"), u["path"].alias("p")).collect()}
    assert {k: v for k, v in got.items() if v != URLS[k]} == {}
    assert one_col(spark, [None]).select(U.parse_http_url("v").alias("u")).first().u is None


def test_names_of_odd_urls(spark):
    cases = {"http://h.org/a/../café.x.html": "h.org_caf_C3_A9.x_zh.html", "http://[::1]/p q/": "___1__p_20q_zh.html", "https://h.org/a/..": "h.org_index_zh.html",
             "nonsense": "webpage_index_zh.html"}
    got = {r.v: r.o for r in one_col(spark, list(cases)).select("v", U.output_name_url("v", "zh").alias("o")).collect()}
    assert got == cases
    given = one_col(spark, ["http://h.org/a"]).select(U.output_name_url("v", "zh", F.lit("my.html")).alias("u"),
                                                      U.output_name_file("v", "zh", F.lit("x.html")).alias("f")).first()
    assert (given.u, given.f) == ("my.html", "x.html")
    crawl = one_col(spark, ["http://H.org/a//b/%2e%2e/c d"]).select(U.crawl_name("v", 1).alias("o")).first().o
    assert crawl == "h.org_a_c%20d_1.html"


def test_files_are_written_once_and_read_back(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(1, "a.html", b"<p>one</p>"), (2, "b.html", b"\xff\xfe"), (3, "c.html", None), (4, "a.html", "é".encode()), (5, "noext", b"5"), (6, "noext", b"6")]
    df = spark.createDataFrame(rows, "page_id long, name string, content binary").repartition(3)
    FILES.write_files(FILES.unique_names(df), out)
    names = sorted(f for _, _, fs in os.walk(out) for f in fs)
    assert names == ["_SUCCESS", "a_1.html", "a_4.html", "b.html", "c.html", "noext_5", "noext_6"]
    assert os.listdir(f"{out}/_temporary") in ([], ) or not any(fs for _, _, fs in os.walk(f"{out}/_temporary"))
    got = {os.path.basename(r.path): (r.html, r.error_class, r.n_bytes) for r in FILES.read_html_files(spark, out).collect()}
    got.pop("_SUCCESS", None)
    # (Spark's file sources skip empty files)
    assert got == {"a_1.html": ("<p>one</p>", None, 10), "a_4.html": ("é", None, 2), "b.html": (None, "file", 2),
                   "noext_5": ("5", None, 1), "noext_6": ("6", None, 1)}
    # a second write replaces the first
    FILES.write_files(df.limit(0), out)
    assert [f for _, _, fs in os.walk(out) for f in fs] == ["_SUCCESS"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"{i}.html" if i else "../evil") for i in range(6)], "page_id long, name string").repartition(6)
    with pytest.raises(Exception, match="not a file name"):
        FILES.write_files(df.withColumn("content", F.lit(b"x")), out)
    # a task that was cut off may leave files in the hidden folder, none is in place
    assert not [d for d in os.listdir(out) if d != "_temporary"] and FILES.read_html_files(spark, out).count() == 0


def test_ids_are_unique_whatever_the_hash(spark):
    paths = spark.range(200).select(F.concat(F.lit("/d/"), F.col("id")).alias("path"))
    for hashed in (F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(5000)), lambda c: F.pmod(F.xxhash64(c), F.lit(600))):
        ids = FILES.path_ids(paths, hashed).collect()
        assert len({r.path for r in ids}) == len({r.page_id for r in ids}) == len(ids) == 200
    assert {r.path: r.page_id for r in FILES.path_ids(paths).collect()} == {r.path: r.h for r in paths.select("path", F.xxhash64("path").alias("h")).collect()}


def test_translated_files_by_name(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "http://h.org/a.html", "x", None), (2, "http://h.org/b/a.htm", "y", None), (3, "http://h.org/", "z", "my/own.html")],
                               "page_id long, url string, html string, given string")
    P.write_translated_files(df.select("page_id", "html"), df, out, "zh", "given")
    assert sorted(f for _, _, fs in os.walk(out) for f in fs) == ["_SUCCESS", "h.org_a_zh_1.html", "h.org_a_zh_2.html", "my_own.html"]
