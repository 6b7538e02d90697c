"""Session helpers.

Library code never picks storage on its own: lineage cuts go to the shared
folder named by ``spark.checkpoint.dir``.  Only :func:`get_session` (tests,
bench, local runs) fills that setting in when it is absent.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the page pipeline relies on.  AQE re-plans joins at runtime and
# splits skewed join partitions; co-partitioning on the leading ``page_id``
# key is safe because a page is size-bounded (see sources.pages.within_size).
PIPELINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # pages are many times their shuffled size once they are taken apart, and compute
    # far outweighs a task's start: tasks are merged up to 4 MB of shuffled bytes, no further
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "babelfold") -> SparkSession:
    master = master or os.environ.get("SPARK_MASTER") or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    for k, v in PIPELINE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in PIPELINE_CONF.items():
        spark.conf.set(k, v)
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        # Local runs only: a cluster names its shared folder in spark.checkpoint.dir.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="babelfold-ckpt-"))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder configured on the session.

    Required on a cluster.  Only a local-mode session (tests, a laptop) without
    one gets a scratch folder of its own.
    """
    d = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d and spark.sparkContext.master.startswith("local"):
        d = tempfile.mkdtemp(prefix="babelfold-ckpt-")
    if not d:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
