"""Cutting lineage by checkpoints and files in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where none is set and master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="riskloom-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder, so that it is computed once and survives lost executors.

    Files go with the last reference to the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as
    ``session.get_spark`` does; else they stay until the folder is emptied.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """Writes ``df`` to files of the shared folder and reads them, for what a loop makes of its own earlier frames.

    A checkpoint keeps the size that was estimated for its plan, and a join multiplies the sizes of its sides.  So a frame
    that a round joins with itself gets an estimate of twice the digits every round, until planning takes all the time;
    files have the size that they have.  They stay until the folder is emptied.
    """
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
