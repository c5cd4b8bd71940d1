"""Session helpers.

Library code never creates a session; it receives one. ``build_session`` is for
tests, the bench and command-line use on a single machine.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "orderpulse", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is. Only when it is unset (tests, a laptop) a fresh local directory is
    set, never a fixed machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder: executors do not share local ones")
        conf_dir = tempfile.mkdtemp(prefix="orderpulse-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def stored_once(df, columns=None):
    """``df`` (or some of its columns) as a Parquet table below the checkpoint directory, for facts that
    several aggregates read: the joins behind them run once and each reader scans the columns it needs.
    A frame that this function returned comes back as it is."""
    if getattr(df, "_stored_once", False):
        return df
    if columns is not None:
        df = df.select(*columns)
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/facts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_once = True
    return out


def materialize(df):
    """Write ``df`` to the checkpoint directory and continue from the written copy.

    For an intermediate read by several jobs (a per-client table ranked three
    times): it is computed once, its lineage is cut, and losing an executor
    afterwards costs a re-read, not a recomputation from the facts."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
