"""Intermediate tables in the folder that the cluster shares for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of its own; on a cluster that
    would be a folder of one machine, so it raises ValueError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet and read again, and its path: lineage ends here, and a
    lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/webquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no remaining plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
