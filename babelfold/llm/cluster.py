"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelfold.operators.translate import ship_package
from babelfold.session import checkpoint_dir


def ready(df: DataFrame) -> SparkSession:
    """The session, with this package importable in Python workers."""
    ship_package(df.sparkSession)
    return df.sparkSession


def cut(df: DataFrame) -> DataFrame:
    """The rows written to a table in the shared checkpoint folder and read
    back: a lost executor loses nothing, the lineage ends here, and the size of
    the table is known to the planner.  (A checkpointed DataFrame keeps the size
    estimate of its plan, and over the joins of an iteration that grows beyond
    all bounds.)  Joins of two such tables sit directly on their exchanges,
    where Spark splits hot keys.  :func:`release` deletes the tables."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def written() -> int:
    """How many tables :func:`cut` has written so far: a mark for :func:`release`."""
    return len(_written)


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def release(spark: SparkSession, start: int = 0, stop: int | None = None) -> None:
    """Deletes the tables that :func:`cut` wrote between two marks; no result may still read them."""
    for k, path in list(enumerate(_written))[start:stop]:
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            _written[k] = ""


FOREST_EDGES = 500_000  # edges that one task joins by itself


def _forest(batches):
    """A partition's edges (a, b) as stars (node, smallest node joined to it here)."""
    up: dict[int, int] = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            up.setdefault(a, a), up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    stars = [(x, root(x)) for x in up]
    stars = [s for s in stars if s[0] != s[1]]
    yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``, the smallest node reachable.

    First every task replaces its edges, FOREST_EDGES at most, by the stars of
    their own components, on fewer and fewer partitions as the edges shrink.  If
    that ends in one partition of that bounded size, it is the answer.  Else
    alternating large-star / small-star rounds join the stars: each is an
    aggregate with map-side partials and a join of two written tables, so a
    node with a third of all edges is split, and no task or driver gathers them.
    Nodes without an edge are not in the result; an empty input gives no rows.
    """
    ready(edges)
    # kept with a > b
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    n = e.count()
    while True:
        parts = max(1, -(-n // FOREST_EDGES))
        # dealt anew, so that no task holds more than its share, however the files are read
        e, was = cut((e.repartition(parts) if parts > 1 else e.coalesce(1)).mapInArrow(_forest, "a long, b long")), n
        if parts == 1:
            return _named(e)
        n = e.count()
        if n > 0.7 * was:
            break
    seen = None
    while True:
        # large star: every larger neighbour of u is linked to the smallest node around u
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        e = cut(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = cut(e.groupBy("a").agg(F.min("b").alias("m")))
        e = cut(e.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .union(low.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return _named(e)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def sampled(df: DataFrame, text: str, rows: int) -> DataFrame:
    """About ``rows`` of the table's distinct texts, those whose hash is under a
    share of all hashes; all of them if there are fewer.  Every task picks its
    own, so no task gathers candidates."""
    some = df.select(F.col(text).cast("string").alias(text)).dropna()
    share = rows / max(df.count(), 1)
    if share < 1:
        some = some.filter(F.xxhash64(text) <= int(share * 2**64) - 2**63)
    return some.groupBy(F.xxhash64(text)).agg(F.first(text).alias(text)).select(text)


SMALL_ROWS = 20_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table, marked for broadcast only if it is counted to have
    ``rows`` rows at most; beyond that the join shuffles both sides."""
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df
