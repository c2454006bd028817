"""Session settings, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "assetlake", **conf) -> SparkSession:
    """A session with the settings the operators assume. On a cluster, leave master unset."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return tune(b.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Settings that can still change on a running session.

    ``forceOptimizeSkewedJoin`` lets adaptive execution split a hot join key even where the
    split costs one more shuffle further up. Co-partitioning on all join keys is what lets
    ``skew.attach`` ask for a shuffle of the small side.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own, which goes when Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a table written by a running job."""
    return f"{checkpoint_dir(spark).rstrip('/')}/assetlake/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: every later read sees the same partitions,
    also after executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
