"""The corpus pipeline: stages over ``documents``, each calling one operator.

A stage takes all that its predecessor kept and returns the columns of
``documents`` (the last one the encoding).  Documents may have further columns
of any name; they are carried along.  Nulls and empty texts follow the
operators' rules: they are neither toxic, nor copies, nor contaminated, and
encode to nothing.  An empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelfold.llm.bpe import digests, encode_decode
from babelfold.llm.cluster import cut, release, written
from babelfold.llm.decontaminate import find_passages
from babelfold.llm.line_dedup import dedup_lines
from babelfold.llm.near_dup import near_duplicates
from babelfold.llm.queries import TOXIC, tokenizer_file
from babelfold.llm.toxicity import score_toxicity, train


def _packed(docs: DataFrame) -> DataFrame:
    """``text`` and all other columns in one struct, so no column can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"), "text")


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*[F.col("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    index = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(_packed(docs), index, columns=["__row", "text"], score="__score", evidence="__evidence")
    return _unpacked(scored.filter(F.col("__score") < TOXIC), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and the documents that consist of nothing else;
    ``n_chars`` is the length of what is left of a changed text."""
    mark = "dropped"
    while mark in docs.columns:
        mark += "_"
    out = dedup_lines(docs, dropped=mark)
    out = out.filter((F.col(mark) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(mark) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    gone = cut(near_duplicates(docs.select("doc_id", "text")).filter("not kept").select(F.col("doc_id").alias("id")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    left = rows.join(gone.hint("merge"), "id", "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    found = find_passages(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), columns=["__row", "text"])
    return _unpacked(found.filter("n_hit = 0"), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text left, decoded again: their digests."""
    return digests(encode_decode(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# the neighbours' votes of the first stage have no SQL form; tests compare every
# stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written once for the next,
    then the tables that the stage wrote on its way are deleted, and its input."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            end = written()
            docs = cut(docs)
            release(spark, at, end)
            at = end
    return docs
