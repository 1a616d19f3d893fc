"""Results that must be computed once only."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local master, where all is one machine, gets a temporary one if none is set (tests)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="curvemill-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and written to the shared folder. What reads it later reads the files: a model or a client is not called again, also when an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
