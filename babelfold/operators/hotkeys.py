"""Joins to a table of one row per key, when a few keys may hold most rows.

AQE splits a hot partition only where the join reads a plain shuffle; here the
other side is an aggregate, which it leaves alone.  So the hot keys are found
first: exact counts per key (an aggregate with map-side partials that the
caller often needs anyway), heavy is what holds more than a ``1 / HEAVY_KEYS``
share of all rows, so there are at most HEAVY_KEYS of them, whatever the size
of the table.  Only their rows get a salt, in proportion to their number, and
only their rows of the other side are repeated, once per salt.  All other keys
are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 1000
PIECES = 8  # pieces of a heavy key per average partition: small ones even out


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """``(key, n)``: rows of each key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(counts: DataFrame, key: str, partitions: int) -> DataFrame:
    """``(h, copies)`` of the heavy keys, HEAVY_KEYS rows at most: the key's hash (so a
    row is small, however long the key) and in how many pieces to split its rows."""
    total = counts.agg(F.sum("n").alias("total")).scalar()
    heavy = counts.filter(F.col("n") * HEAVY_KEYS > total)
    copies = F.ceil(F.col("n") * F.lit(float(partitions * PIECES)) / total).cast("int")
    # two keys of one hash share the greater number: a needless salt changes no result
    return heavy.select(F.xxhash64(key).alias("h"), copies.alias("copies")).groupBy("h").agg(F.max("copies").alias("copies"))


def join_unique(rows: DataFrame, unique: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined on ``key`` to ``unique`` (one row per key), hot keys split.

    A null key matches nothing, and its rows are split like those of any hot key.
    ``rows`` needs further columns that tell its rows apart (an id): the salt is
    a hash of them, so a task that runs again deals its rows alike.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(counts if counts is not None else key_counts(rows, key), key, partitions)
    heavy = F.broadcast(heavy.select(F.col("h").alias("__heavy"), F.col("copies").alias("__copies")))
    others = [c for c in rows.columns if c != key]
    salted = (rows.withColumn("__h", F.xxhash64(key)).join(heavy, F.col("__h") == F.col("__heavy"), "left")
              .withColumn("__salt", F.when(F.col("__copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*others), F.col("__copies"))).cast("int"))
              .drop("__h", "__heavy", "__copies"))
    values = [c for c in unique.columns if c != key]
    spread = (unique.filter(F.col(key).isNotNull()).withColumn("__h", F.xxhash64(key)).join(heavy, F.col("__h") == F.col("__heavy"), "left")
              .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__copies"), F.lit(1)) - 1)))
              .select(F.col(key).alias("__key"), "__salt", *values))
    # both sides are dealt by (key, salt), also where a side already is by the key alone
    left, right = salted.repartition(key, "__salt"), spread.repartition("__key", "__salt").withColumnRenamed("__salt", "__salt2")
    joined = left.join(right, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__salt2")), "left")
    return joined.drop("__salt", "__salt2", "__key")
