"""Session helpers of the subpackage: tables, durable checkpoints, partition counts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import durable, shared_dir

__all__ = ["bucketed", "durable", "held_out", "shards", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, through Spark's reader, so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn labels from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shards(df: DataFrame, per_shard: int, rows: int) -> int:
    """A partition count in proportion to the rows, at least the session's own setting."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(own, math.ceil(rows / per_shard))


@contextmanager
def bucketed(df: DataFrame, key: str, parts: int) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, in buckets by ``key``, so that joins on it don't shuffle ``df`` again.

    The table and its files go when the block ends: what is made from it has to be written before.
    """
    spark = df.sparkSession
    name = f"riskloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    parts = min(parts, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    try:
        df.write.bucketBy(parts, key).option("path", path).option("parquet.block.size", 32 << 20).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
