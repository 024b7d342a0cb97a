"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of text whose keyed records one shard holds.
SHARD_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a temporary folder, but only with a local master, as in tests:
    on a cluster each executor would write to a disk of its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet: later readers neither work them out again nor depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shards(spark: SparkSession, n_bytes: int) -> int:
    """Groups to deal keyed work over ``n_bytes`` of text into: at least as many as the session's shuffle partitions, and
    so many that each holds what SHARD_BYTES of text give, whatever that setting is. One task works on one at a time."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-n_bytes // SHARD_BYTES))
