"""Lineage cuts in the shared folder, and broadcasts of counted frames."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frame is broadcast only when a count has shown it to be below this many bytes.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only a session in one process may go without, with a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if not hasattr(spark, "_lodestone_scratch"):
        import tempfile

        spark._lodestone_scratch = tempfile.mkdtemp(prefix="lodestone-")
    return spark._lodestone_scratch


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if its counted rows fit the limit, else unchanged (a shuffled join follows).

    ``row_bytes`` is the width of a row of fixed size, or a column with each row's own. The
    frame should be a cheap one (see ``cut``), as it is counted first.
    """
    if isinstance(row_bytes, Column):
        return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= limit else df
    return F.broadcast(df) if df.limit(limit // row_bytes + 1).count() * row_bytes <= limit else df


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows in tasks of about ``rows``, one a core at least: for passes whose work goes by rows and not by the bytes that a narrow table has."""
    return df.repartition(max(-(-df.count() // rows), df.sparkSession.sparkContext.defaultParallelism))


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, for passes that cost far more than its rows are wide; larger ones unchanged.

    A scan is not split below ``spark.sql.files.openCostInBytes``, so tables under that size
    a core cannot keep all cores busy. What is larger has splits enough and is not shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) <= least * cores else df
