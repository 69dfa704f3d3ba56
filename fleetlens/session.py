"""Session settings shared by tests, the bench and jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC clocks and AQE. On a cluster leave ``master`` unset and size
    ``spark.sql.shuffle.partitions`` from the cluster; AQE coalesces what is too fine."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings every query relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, one process that is driver and executor at once (``local[n]``) gets a folder
    of its own; on a cluster that is an error, as executors could not read each other's files."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if current := sc.getCheckpointDir():
            return current
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder; readers after it survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
