"""Results kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is named, a temporary one in local mode, where driver and executors
    are one process; an error on a cluster, whose machines don't share such a folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that a lost executor or a rerun sees the same ones."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
