"""Response unwrapping, marker parsing, scatter (last write wins), success rate."""

from pyspark.sql import functions as F

from babelfold.operators import responses as R

BODIES = {
    '{"data":"[0] x"}': "[0] x",
    '{"text":"[0] x"}': "[0] x",
    '{"result":"[0] x"}': "[0] x",
    '{"data":null,"text":"[0] x"}': '{"data":null,"text":"[0] x"}',
    '{"data":5,"text":"[0] x"}': '{"data":5,"text":"[0] x"}',
    '{"x":1}': '{"x":1}',
    "[0] x": "[0] x",
    '{"data":"[0] x"} zz': '{"data":"[0] x"} zz',
}


def test_unwrap_golden(spark):
    df = spark.createDataFrame([(b,) for b in BODIES], "b string").select("b", R.unwrap_response("b").alias("t"))
    assert {r.b: r.t for r in df.collect()} == BODIES


def _marked(spark, text, n=None):
    df = spark.createDataFrame([(1, 0, text)], "page_id long, batch_idx long, text string")
    if n is not None:
        df = df.withColumn("n", F.lit(n).cast("long"))
    return R.parse_markers(df)


def test_marker_lines(spark):
    text = "[0] a\n  [1]b\n[2]\n[2]   \nx [3] c\n[99999999999999999999] big\n[4] d  "
    got = [(r.seq, r.text) for r in _marked(spark, text).orderBy("line_no").collect()]
    assert got == [(0, "a"), (1, "b"), (4, "d")]


def test_last_write_wins_and_repeats_count(spark):
    m = _marked(spark, "[0] a\n[0] b\n[7] out", n=2)
    tr = {r.seq: r.translation for r in R.scatter(m).collect()}
    assert tr == {0: "b"}
    batches = spark.createDataFrame([(1, 0, 2)], "page_id long, batch_idx long, n long")
    sr = R.success_rate(m, batches).first()
    assert (sr.n_accepted, sr.n_covered, sr.success_rate, sr.covered_rate) == (2, 1, 100.0, 50.0)


def test_later_batch_wins(spark):
    df = spark.createDataFrame([(1, 0, 3, "[1] early"), (1, 1, 3, "[1] late")],
                               "page_id long, batch_idx long, n long, text string")
    tr = {r.seq: r.translation for r in R.scatter(R.parse_markers(df)).collect()}
    assert tr == {1: "late"}


def test_failed_batches(spark):
    df = spark.createDataFrame([(1, 0, None, "api"), (1, 1, "ok", None), (2, 0, None, "network")],
                               "page_id long, batch_idx long, response string, error_class string")
    got = {r.error_class: r.n_batches for r in R.failed_batches(df).collect()}
    assert got == {"api": 1, "network": 1}
