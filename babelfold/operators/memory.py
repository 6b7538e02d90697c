"""Reuse across pages: content hashing, page dedupe and a translation memory.

Corpus-wide keys (a content hash, a segment text) can be hot -- one text may
sit on a third of all pages.  Every grouping here is a hash aggregate with a
map-side partial step, so a hot key collapses before the shuffle; the joins
back to the rows split the rows of hot keys (:mod:`babelfold.operators.hotkeys`).
Nothing is collected to the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelfold.operators.hotkeys import join_unique, key_counts
from babelfold.session import cut_lineage


def content_hash(col) -> Column:
    """Portable page identity (SHA-256 hex)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sha2(c, 256)


def dedup_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, rep_id, n_copies)``: every page mapped to the smallest id with the same content."""
    # pages without content are copies of each other, none is lost
    h = pages.select(id_col, F.coalesce(content_hash(html_col), F.lit("")).alias("h"))
    reps = h.groupBy("h").agg(F.min(id_col).alias("rep_id"), F.count(F.lit(1)).alias("n"))
    joined = join_unique(h, reps.select("h", "rep_id", F.col("n").alias("n_copies")), "h", counts=reps)
    return joined.select(id_col, "rep_id", "n_copies")


def representatives(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Only the pages that have to be processed (one per distinct content)."""
    d = dedup_pages(pages, id_col)
    return pages.join(d.filter(F.col(id_col) == F.col("rep_id")).select(id_col), id_col, "left_semi")


def newest_entries(memory: DataFrame, lang: str | None) -> DataFrame:
    """``(text, translation)``, one entry per text: the newest (of equal age the
    larger), so no segment is doubled.  A table without ``lang`` holds one language."""
    if lang is not None and "lang" in memory.columns:
        memory = memory.filter(F.col("lang") == lang)
    order = F.struct(*[c for c in ("run_ts", "translation") if c in memory.columns])
    return memory.groupBy("text").agg(F.max_by("translation", order).alias("translation"))


def tm_split(segments: DataFrame, memory: DataFrame, lang: str) -> DataFrame:
    """Mark each segment as a memory hit (with its translation) or a miss.

    The memory is probed once per DISTINCT text (aggregated first), then the
    answer is joined back to the segments; a hot text costs one probe, and its
    segments are spread over tasks.
    """
    counts = key_counts(segments, "text")
    probe = counts.join(newest_entries(memory, lang), "text", "left").filter("n > 0").select("text", "translation")
    j = join_unique(segments, probe, "text", counts=counts)
    return j.withColumn("hit", F.col("translation").isNotNull())


def tm_merge(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Union old and new entries; per (lang, text) the newest run wins."""
    cols = ["lang", "text", "translation", "run_ts"]
    u = memory.select(*cols).unionByName(new.select(*cols))
    return u.groupBy("lang", "text").agg(
        F.max_by("translation", F.struct("run_ts", "translation")).alias("translation"),
        F.max("run_ts").alias("run_ts"),
    )


MEMORY_SCHEMA = "lang string, text string, translation string, run_ts long"
BUCKETS = 256


class MemoryTable:
    """A translation memory kept as a table: Parquet folders ``bucket=<k>``, the bucket
    being a hash of language and text, one entry per text.

    :meth:`update` rewrites only the buckets that new entries fall into, each of
    them whole: their old entries are read (the other folders aren't), merged and
    written to the shared checkpoint folder first, then put in place.  So what a
    run writes follows its new texts, as long as they are fewer than the buckets;
    choose ``buckets`` so that one holds what a run may rewrite (100 MB, say).
    The number is fixed when the table is first written.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_memory.json")
        fs = meta.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(meta):
            self.buckets = json.loads(self._read(fs, meta))["buckets"]
        else:
            self.buckets = buckets
            out = fs.create(meta, True)
            out.write(bytearray(json.dumps({"buckets": buckets}).encode()))
            out.close()

    @staticmethod
    def _read(fs, path) -> str:
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("lang", "text"), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All entries, or those of some buckets."""
        df = self.spark.read.schema(MEMORY_SCHEMA + ", bucket int").parquet(self.path)
        df = df if buckets is None else df.filter(F.col("bucket").isin(buckets))
        return df.select("lang", "text", "translation", "run_ts")

    def update(self, new: DataFrame) -> list[int]:
        """Merges ``new(lang, text, translation, run_ts)``, the newest run winning; the
        buckets rewritten (a number each, BUCKETS at most)."""
        new = cut_lineage(new.select("lang", "text", "translation", "run_ts").filter("text is not null"))
        touched = sorted(r.b for r in new.select(self._bucket().alias("b")).distinct().collect())
        if touched:
            merged = cut_lineage(tm_merge(self.read(touched), new).withColumn("bucket", self._bucket()).repartition("bucket"))
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched
