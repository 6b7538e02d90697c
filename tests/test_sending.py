"""Hot keys, distinct sending, calls in flight, dictionary, re-sends, repeated page ids."""

import time
from statistics import median

import pytest
from pyspark.sql import functions as F

from babelfold.operators import memory as MEM
from babelfold.operators import translate as TR
from babelfold.operators.hotkeys import heavy_keys, join_unique, key_counts
from babelfold.plans.pipeline import translate_pages
from support import SF_SMALL


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "page_id long, html string")


@pytest.fixture
def many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_text_is_spread_and_nothing_else_changes(spark, many_partitions):
    # half of the rows hold one text, a sixth have none
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("seq"), F.when(F.col("id") % 2 == 0, F.lit("hot")).when(
        F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    memory = spark.sql("""SELECT 'zh' AS lang, 'hot' AS text, 'HOT' AS translation, 1L AS run_ts
                          UNION ALL SELECT 'zh', concat('t', id), concat('T', id), 1L FROM range(0, 60000, 5)""")
    got = MEM.tm_split(rows, memory, "zh")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 3 * median(sizes)
    plain = rows.join(memory.select("text", "translation"), "text", "left").select("doc_id", "text", "translation")
    got = got.select("doc_id", "text", "translation")
    assert got.count() == 60_000 and got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    assert heavy_keys(key_counts(rows, "text"), "text", 40).count() == 2


def test_hot_pages(spark, many_partitions):
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, F.lit("<p>same</p>")).when(
        F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("p"), F.col("id"))).alias("html"))
    got = MEM.dedup_pages(pages)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * median(sizes)
    by = {r.page_id: (r.rep_id, r.n_copies) for r in got.collect()}
    assert by[4] == (0, 10_000) and by[9] == (3, 3333) and by[7] == (7, 1) and len(by) == 20_000


def test_join_unique_of_nothing(spark):
    rows = spark.createDataFrame([], "id long, k string")
    unique = spark.createDataFrame([("a", 1)], "k string, v int")
    assert join_unique(rows, unique, "k").count() == 0
    some = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, k string")
    assert {(r.id, r.v) for r in join_unique(some, unique.limit(0), "k").collect()} == {(1, None), (2, None), (3, None)}


def test_a_text_on_all_pages_is_sent_once(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", F.concat("html", F.lit("<p>On every page</p>")).alias("html"))
    plain = translate_pages(pages)
    once = translate_pages(pages, distinct=True)
    sent = once.batches.select(F.explode("items.text").alias("t")).groupBy("t").count()
    assert sent.filter("count > 1").isEmpty() and sent.filter("t = 'On every page'").count() == 1
    assert {r.page_id: r.html for r in once.pages.collect()} == {r.page_id: r.html for r in plain.pages.collect()}
    # with a memory only what it lacks is sent, still once
    memory = plain.tmap.select(F.lit("zh").alias("lang"), "text", "translation", F.lit(1).cast("long").alias("run_ts")).filter("length(text) % 2 = 0")
    part = translate_pages(pages, distinct=True, memory=memory)
    assert part.batches.select(F.explode("items.text").alias("t")).filter("length(t) % 2 = 0").isEmpty()
    assert {r.page_id: r.html for r in part.pages.collect()} == {r.page_id: r.html for r in plain.pages.collect()}


def test_calls_in_flight_are_bounded_and_in_order():
    running, most = [], []

    def slow(request):
        running.append(1)
        most.append(len(running))
        time.sleep(0.1 if request != "3" else 0.25)
        running.pop()
        return f"r{request}"
    t0 = time.monotonic()
    got = list(TR.calls_in_flight(slow, (TR.Request(str(i)) for i in range(20)), window=5, timeout_s=5))
    assert time.monotonic() - t0 < 1.0 and max(most) <= 5
    assert got == [(f"r{i}", None, None) for i in range(20)]


def test_a_call_over_the_time_limit_is_a_network_error():
    def hang(request):
        time.sleep(1.0 if request == "1" else 0)
        return str(request)
    t0 = time.monotonic()
    got = list(TR.calls_in_flight(hang, (TR.Request(str(i)) for i in range(6)), window=2, timeout_s=0.2))
    assert time.monotonic() - t0 < 0.9
    assert [g[0] for g in got] == ["0", None, "2", "3", "4", "5"] and got[1][1] == "network"


def test_requests_carry_language_body_and_key(spark):
    def fn(request):
        import json
        body = json.loads(request.body)
        assert body == {"text": str(request), "source_lang": "auto", "target_lang": "fr"} and len(request.key) == 64
        return request.replace("] ", f"] {request.target_lang}:{request.key[:4]}:")
    page = pages_df(spark, [(1, "<p>Hello World</p>")])
    out = translate_pages(page, translator=fn, lang="fr").pages.first().html
    assert out == f"<p>fr:{TR.Request('[0] Hello World', 'fr').key[:4]}:Hello World</p>"
    with pytest.raises(ValueError):
        translate_pages(page, lang="xx")


def test_dictionary_translator(spark):
    entries = spark.createDataFrame([("zh", "Hello", "old", 1), ("zh", "Hello", "Nihao", 2), ("ja", "World", "Sekai", 1), ("zh", "One", "[9] Yi", 1)],
                                    "lang string, text string, translation string, run_ts long")
    page = pages_df(spark, [(1, "<p>Hello</p><b>World</b><i>One</i>"), (2, "<p>Nothing here</p>")])
    r = translate_pages(page, translator=TR.TableTranslator(entries))
    assert {x.page_id: x.html for x in r.pages.collect()} == {1: "<p>Nihao</p><b>World</b><i>[9] Yi</i>", 2: "<p>Nothing here</p>"}
    plan = r.pages._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "Python" not in plan


def test_only_failed_batches_are_sent_again(spark, tmp_path):
    log = str(tmp_path)

    def factory():
        import os
        import uuid

        def flaky(request):
            seen = sum(f.startswith(request.key) for f in os.listdir(log))
            open(f"{log}/{request.key}-{uuid.uuid4().hex}", "w").close()
            if "Two" in request and seen < 2:
                raise ConnectionError("try again")
            if "Never" in request:
                raise ValueError("no")
            return str(request)
        return flaky
    pages = pages_df(spark, [(1, "<p>One</p>"), (2, "<p>Two</p>"), (3, "<p>Three</p>"), (4, "<p>Never</p>")])
    r = translate_pages(pages, translator=TR.PythonTranslator(factory), rounds=3)
    got = {x.page_id: (x.error_class, x.response) for x in r.responses.collect()}
    assert got == {1: (None, "[0] One"), 2: (None, "[0] Two"), 3: (None, "[0] Three"), 4: ("internal", None)}
    import os
    calls = {}
    for f in os.listdir(log):
        calls[f.split("-")[0]] = calls.get(f.split("-")[0], 0) + 1
    assert {t: calls[TR.Request(f"[0] {t}").key] for t in ("One", "Two", "Three", "Never")} == {"One": 1, "Two": 3, "Three": 1, "Never": 3}


def test_rows_of_one_page_id_do_not_mix(spark):
    pages = pages_df(spark, [(1, "<h1>Alpha one</h1>"), (1, "<p>Beta two</p>"), (2, "<p>Gamma</p>"), (2, "<p>Gamma</p>"), (None, "<p>x</p>")])
    r = translate_pages(pages)
    out = sorted((x.page_id or 0, x.html) for x in r.pages.collect())
    assert len(out) == 5 and out[0] == (0, "<p>x</p>") and out[3:] == [(2, "<p>Gamma</p>"), (2, "<p>zh:Gamma</p>")]
    assert {h for _, h in out[1:3]} in ({"<h1>zh:Alpha one</h1>", "<p>Beta two</p>"}, {"<h1>Alpha one</h1>", "<p>zh:Beta two</p>"})
    assert sorted(x.error_message for x in r.rejected.collect()) == ["page_id is NULL", "page_id occurs before", "page_id occurs before"]
