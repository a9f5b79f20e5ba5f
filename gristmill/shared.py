"""Tables and files in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, else under the context's checkpoint folder; it goes when the driver ends.

    Where neither is set, a local master gets a temporary folder; a cluster has
    no folder that all executors surely see, so there it is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/files/{uuid.uuid4().hex}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: computed once, and read again after the loss of an executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
