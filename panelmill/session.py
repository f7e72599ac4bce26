"""Session helpers: a tuned local session and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelmill")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; only a local session may invent one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(shared)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read on from there.

    The rows survive the loss of executors, and values that depend on how rows were
    partitioned (ids per partition) can no longer change on a replay.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
