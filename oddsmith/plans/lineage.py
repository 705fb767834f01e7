"""Tables that cut lineage, and numbering without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Shuffle files of a write go when it is done, as its rows are read from the table from then on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which `spark.checkpoint.dir` names. Where it
    is not set, a temporary one serves on a local master only: executors of a cluster would not see it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="oddsmith-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written as a table into the shared folder and read back, so that later steps
    start from files: a lost executor costs only its own tasks. The table goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """df with `name`, from 0 in the given order. Ranges of rows are sorted apart; the
    driver sees their counts only, a row for each partition."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    starts, at = [], 0
    for part, count in counts:
        starts.append((part, at))
        at += count
    table = df.sparkSession.createDataFrame(starts, "_part int, _at long")
    k = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(table), "_part").withColumn(name, k - 1 + F.col("_at")).drop("_part", "_at")
