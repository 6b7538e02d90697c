"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is fully executed once through the ``noop`` sink (nothing is
collected to the driver), after an untimed warm-up of the JVM on sf0.01.  Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "translate_pages",   # flagship: pages -> translated pages
    "html_tokens",
    "segments",
    "batch_plan",
    "render_html",
    "run_metrics",
    "unwrap_response",
    "parse_markers",
    "scatter",
    "is_translatable",
    "tm_lookup",
    "page_dedup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("BENCH_CPUS", cpus)
    from babelfold.plans.queries import queries
    from babelfold.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    # warm-up (not timed): JVM JIT and codegen caches, on a smaller scale if present
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    warm = warm if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir) else sf_dir
    for name in ("translate_pages", "parse_markers"):
        qs[name](spark, warm).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    pages_bytes = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("sum(octet_length(html))").first()[0]
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    flag = times["translate_pages"]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "pages_per_sec": round(n_pages / flag, 1) if flag else None,
        "kb_per_sec": round(pages_bytes / 1024 / flag, 1) if flag else None,
        "cpus": int(cpus),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
