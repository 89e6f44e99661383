"""Session construction and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "fairspark", **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    Only engine-level defaults are set; anything the cluster already configures
    (executors, shuffle partitions, checkpoint folder) is left alone unless passed.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, streaming state and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset a local
    master gets a fresh temporary folder; a cluster has to set it, because a
    machine-local folder would be lost together with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="fairspark-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below :func:`scratch_root`."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    Cuts the lineage of iterative operators and fixes the input of plans that
    read the same intermediate several times; survives executor loss.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder as compressed columns and read it back.

    Later branches read columns of the file instead of computing ``df`` again, and a lost executor
    costs a re-read. The folder belongs to the cluster, which expires it. ``rows_per_file`` makes files
    small, so that a table which is read many times is dealt to the cores evenly; 0 sets no limit.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
