"""Session settings that the operators count on, and access to the test tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spandrel")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the folder that the cluster names in spark.checkpoint.dir.

    All executors share that folder, so the result survives the loss of any of them.  Only where the
    setting is missing and all runs on this machine, as in tests, a temporary folder of it is used; a
    cluster without the setting is refused.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spandrel-"))
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """The frame over at least as many tasks as there are cores, for work that costs far more than a shuffle.

    Large tables are scanned by more tasks than that already and stay as they are; only a table in a
    few files, smaller than the cluster, is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)
