"""File-stream translation: every landed page comes out translated exactly once."""

import os
import tempfile

from babelfold.streaming.pages_stream import translate_stream
from support import SF_SMALL


def test_stream_translates_landed_pages(spark):
    root = tempfile.mkdtemp(prefix="bf-stream-", dir="/tmp")
    src, sink, ckpt = (os.path.join(root, d) for d in ("in", "out", "ckpt"))
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    pages.filter("page_id < 25").write.parquet(os.path.join(src, "part1"))
    pages.filter("page_id >= 25").write.parquet(os.path.join(src, "part2"))
    q = translate_stream(spark, src + "/*", sink, ckpt, max_files_per_trigger=1)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == pages.count()
    assert out.select("page_id").distinct().count() == pages.count()
    assert out.filter("html like '%<h1>zh:%'").count() == pages.count()
