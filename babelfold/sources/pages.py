"""Sources and sinks.

The reference reads one HTML file or one crawled page per run.  Here a page
is a row: ``pages(page_id, url, html)`` from a table, or a folder of HTML
files (:mod:`babelfold.sources.files`).  Output goes out as a table with the
output name as a column, or as files under their output names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelfold.functions import urls as U
from babelfold.sources import files as FILES

# --- fixed values -------------------------------------------------------------------
from babelfold.operators.tokens import MAX_PAGE_BYTES  # noqa: E402  (50 MiB page limit)
# --------------------------------------------------------------------------------------


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages ``(page_id, url, html)`` (the crawl result is an input table)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def within_size(html: Column, max_bytes: int = MAX_PAGE_BYTES) -> Column:
    return F.octet_length(html) <= F.lit(max_bytes)


def write_pages(df: DataFrame, path: str, lang_col: str = "lang") -> None:
    """Sink: translated pages as parquet, one folder per target language.
    Only the languages written are replaced; others in the path stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(lang_col).parquet(path)


def write_translated_files(pages: DataFrame, urls: DataFrame, path: str, lang: str, explicit: str | None = None) -> None:
    """Sink: each page of ``pages(page_id, html)`` as a file under the output name of its
    URL in ``urls(page_id, url)`` (the name in column ``explicit`` where it holds one).
    Names are made unique before they meet the pages, which are worked out once."""
    given = F.regexp_replace(F.col(explicit), "[/]", "_") if explicit else None
    names = FILES.unique_names(urls.select("page_id", U.output_name_url("url", lang, given).alias("name")))
    FILES.write_files(pages.join(names, "page_id").select("name", F.col("html").cast("binary").alias("content")), path)
