"""Tables written to the folder that the driver and all executors share, and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that go to a Python worker, or come back, at once; a larger row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes that a task buffers before it writes them to a table's file.
ROW_GROUP_BYTES = 16 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the checkpoint folder of its context.

    Where neither is set: on one machine (a local master) a new temporary
    folder, which becomes the context's; on a cluster the warehouse, unless that
    is a folder of each machine, which is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if _path(spark, warehouse)[0].getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share; the warehouse is a folder of each machine")
            return warehouse
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def _path(spark: SparkSession, name: str):
    """(file system, path) of a folder, as Hadoop has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def materialize(df: DataFrame, name: str, by: Sequence[str] = (), folder: str | None = None) -> DataFrame:
    """Writes df as a table of the shared folder and reads it again.

    This cuts the lineage: losing an executor afterwards costs only a reread.
    What the plan shuffled is deleted as soon as the table stands.  The table
    goes with discard(), or else when the driver ends; one written to a given
    `folder`, which must not exist, stays.  It may be partitioned by its last columns.
    """
    spark = df.sparkSession
    path = folder or f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if folder is None:
        system, where = _path(spark, path)
        system.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing reads any more."""
    for table in tables:
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            system, path = _path(table.sparkSession, folder)
            system.delete(path, True)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema), where Arrow batches are bounded by bytes.

    Spark bounds batches by rows alone unless told otherwise, and ten thousand
    texts may be any size.  The setting is the session's and stays.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def numbered(docs: DataFrame, key: str, text: str, number: str, nulls_first: bool = False) -> DataFrame:
    """docs with a long column `number` that differs between rows and grows with the key.

    Integer keys that are unique and never null are their own numbers.  Else rows
    are sorted in ranges by key, then a hash of the text, then where they were
    read, and are written with their places; so keys may be of any type that can
    be sorted, and equal rows get different numbers.
    """
    column = F.col(key)
    if isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        odd = docs.groupBy(column.alias("k")).agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL")
        if not odd.limit(1).count():
            return docs.withColumn(number, column.cast("long"))
    none = column.isNotNull() if nulls_first else column.isNull()
    read = docs.withColumn(number, F.monotonically_increasing_id())
    order = [none, column, F.xxhash64(F.col(text).cast("string")), F.col(number)]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = read.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ranked.withColumn(number, F.monotonically_increasing_id()), "numbered")
