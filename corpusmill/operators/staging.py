"""Global order without a one-task window: rows dealt into ranges, staged, and numbered by the ranges' counts."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="corpusmill-")


def _own_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local session without one gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    return f"{where.rstrip('/')}/corpusmill/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column, name: str = "i") -> DataFrame:
    """df with `name`: 0, 1, 2, ... along a total order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    rows = staged(ranged, "numbered").withColumn("_range", F.shiftright("_mid", 33))
    # One row for each range, of which there are as many as staged files.
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", (ahead - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_mid") + F.col("_shift")).drop("_mid", "_range", "_shift")
