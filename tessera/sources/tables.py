"""Parquet tables of a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where its files give fewer partitions than there are cores, for work that is heavy on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the folder that driver and executors share (spark.checkpoint.dir) and read back.

    On a local master a temporary folder will do where that is unset. The table is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    top = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tessera-")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
