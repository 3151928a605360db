"""Session helpers: settings, shared working folder, parallelism of small inputs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cpus: int = 8, app_name: str = "topicflow") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("TOPICFLOW_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names.

    Executors must all see it, so a machine-local folder is only used when the
    session itself is local and the setting is absent.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="topicflow-")
        spark.conf.set(CHECKPOINT_SETTING, root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def lasting_dir(spark: SparkSession, name: str) -> str:
    """A folder below the shared one that later runs find again."""
    return f"{shared_root(spark)}/{name}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than cores one split per core.

    A large table is already split finely enough and passes through untouched,
    so the exchange only ever moves inputs that are small for the cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
