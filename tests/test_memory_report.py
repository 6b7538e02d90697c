"""Memory tables that rewrite touched buckets only; the report of a run."""

import os

import pytest
from pyspark.sql import functions as F

from babelfold.operators import memory as MEM
from babelfold.operators import translate as TR
from babelfold.plans.pipeline import translate_pages, translate_to
from support import SF_SMALL


def entries(spark, n, run, prefix="t"):
    return spark.range(n).select(F.lit("zh").alias("lang"), F.concat(F.lit(prefix), "id").alias("text"),
                                 F.concat(F.lit(f"r{run}:"), "id").alias("translation"), F.lit(run).cast("long").alias("run_ts"))


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_size for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_an_update_writes_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "memory")
    t = MEM.MemoryTable(spark, path, buckets=64)
    assert t.read().count() == 0 and t.update(entries(spark, 0, 1)) == []
    assert len(t.update(entries(spark, 20_000, 1))) == 64
    before = files_of(path)
    touched = t.update(entries(spark, 2, 2))
    after = files_of(path)
    new = sum(size for f, size in after.items() if f not in before)
    assert 1 <= len(touched) <= 2 and new < 0.05 * sum(before.values())
    got = {r.text: (r.translation, r.run_ts) for r in t.read().collect()}
    assert len(got) == t.read().count() == 20_000 and got["t0"] == ("r2:0", 2) and got["t1"] == ("r2:1", 2) and got["t2"] == ("r1:2", 1)
    # an older run doesn't win, null texts are no entries, and the number of buckets stays
    again = MEM.MemoryTable(spark, path, buckets=7)
    assert again.buckets == 64
    again.update(entries(spark, 1, 1).union(entries(spark, 1, 3).withColumn("text", F.lit(None).cast("string"))))
    assert {r.text: r.run_ts for r in again.read().filter("text in ('t0', 't1')").collect()} == {"t0": 2, "t1": 2}
    assert again.read().count() == 20_000


def test_report_of_a_run_with_and_without_a_memory(spark, tmp_path):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    plain = translate_pages(pages)
    n_seg, applied = plain.segments.count(), plain.pages.agg(F.sum("n_applied")).first()[0]
    r = translate_to(pages, str(tmp_path / "a")).first()
    assert (r.n_pages, r.texts_kept, r.n_hits, r.n_misses, r.hit_rate, r.n_applied) == (50, n_seg, 0, 0, None, applied)
    assert r.texts_collected >= n_seg and r.texts_filtered == r.texts_collected - n_seg and r.n_batches == plain.batches.count()
    assert r.bytes_in == pages.agg(F.sum(F.octet_length("html"))).first()[0] and r.bytes_out > r.bytes_in and r.change_pct > 0
    assert r.ms > 0 and r.kb_per_s == pytest.approx(r.bytes_in / 1024 / (r.ms / 1000)) and r.grade in (1, 2, 3, 4)
    out = {x.page_id: x.html for x in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert out == {x.page_id: x.html for x in plain.pages.collect()}
    memory = plain.tmap.select(F.lit("zh").alias("lang"), "text", "translation", F.lit(1).cast("long").alias("run_ts"))
    r = translate_to(pages, str(tmp_path / "b"), memory=memory).first()
    assert (r.n_hits, r.n_misses, r.hit_rate, r.n_batches, r.n_applied) == (n_seg, 0, 1.0, 0, applied)
    r = translate_to(pages, str(tmp_path / "c"), translator=TR.python_prefix("zh", fail_over_bytes=0)).first()
    assert r.n_failed_batches == r.n_batches > 0 and r.n_applied == 0 and r.bytes_out == r.bytes_in


def test_pages_are_not_taken_apart_again_for_each_reading_of_the_memory(spark):
    """The split reads the segments several times: they are written once before."""
    pages = spark.createDataFrame([(i, f"<p>text {i % 3}</p>") for i in range(20)], "page_id long, html string")
    memory = spark.createDataFrame([("zh", "text 1", "t")], "lang string, text string, translation string")
    r = translate_pages(pages, memory=memory)
    assert "regexp_extract_all" not in r.segments._jdf.queryExecution().optimizedPlan().toString()
    assert r.split.filter("hit").count() == 7 and r.split.count() == 20


def test_small_pages_are_dealt_over_several_tasks(spark):
    """Few shuffled bytes are much work: they don't end up in one task."""
    from babelfold.operators import tokens as TK

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.sha2(F.concat_ws("-", F.col("id"), i), 256)), "</p><p>")
    pages = TK.partition_pages(spark.range(400).select(F.col("id").alias("page_id"), body.alias("html")))
    assert len(pages.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("html"))).collect()) > 1


def test_resource_pieces_made_before_the_switches_change_no_page(spark):
    from babelfold.operators import resources as RES, tokens as TK

    html = '<link rel=stylesheet href=a><p onclick="x" style="y" title="t">a<img src=b><script>var z</script><style>q</style></p>'
    t = TK.tokenize(TK.partition_pages(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")))
    keys = lambda df: df.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("css"))
    got, plain = (sorted(map(tuple, RES.strip_resources(x, "css", by=("css",)).collect()), key=str) for x in (keys(RES.with_resource_pieces(t)), keys(t)))
    assert got == plain and len(got) == 4 and any("onclick" not in str(x) and "<style>q" in str(x) for x in got)
