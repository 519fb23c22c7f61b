"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, set as the checkpoint folder too. Where it is unset a local session gets a folder of its own; on a
    cluster executors would not see that, so there it is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed: its lineage ends there, and what reads it several times doesn't compute it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
