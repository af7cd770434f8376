"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of global ranks are dropped once their DataFrames are garbage
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # min/max/count from Parquet footers where possible (window end dates)
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "basketry", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster, call without ``master`` and let spark-submit decide; the shuffle partition count
    should then be sized for the data (roughly input bytes / 128 MB), not for the local core count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, reading ``spark.checkpoint.dir`` from the session.

    A cluster must name a shared folder there; only a ``local[...]`` master, where driver and executor
    are one process, gets a fresh temp folder when nothing is configured.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; the cluster must name the folder
        return spark.conf.get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.environ.get("TMPDIR", "/tmp")
        conf_dir = tempfile.mkdtemp(prefix="basketry-ckpt-", dir=base)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def application_id(spark: SparkSession) -> str:
    """The running application's id (classic sessions and Spark Connect)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        return spark.conf.get("spark.app.id", "connect")
