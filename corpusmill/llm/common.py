"""What the operators share: reading tables, staging to the shared folder, and global order without a one-task window."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = _local_folder(spark.sparkContext.applicationId)
    return where.rstrip("/")


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="corpusmill-")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB from now on in this session, where it has Spark's 64: several Python workers share an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, "8m")


def clear_staged(spark: SparkSession) -> None:
    """Removes everything that operators have staged in the shared folder; results that weren't read yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corpusmill")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession):
    """Within the block, a query's shuffle files go when it ends: what it wrote is in the shared folder."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: str | list[str] | None = None, path: str | None = None) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here, and a lost executor costs a reread.

    Into `path`, where it is given, beside the files that are there; these are read back too.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = path or staged_path(spark, name)
    writer = df.write.mode("append").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with _shuffles_freed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df dealt into ranges of `order`, sorted, and staged with `_mid`: ascending along that order over the whole table.

    Within one range the numbers have no gaps, so that a rank is `_mid` less the least of its range, plus the rows of
    the ranges before it; these counts have one row for each range and group, whatever the table's size.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ranged.withColumn("_mid", F.monotonically_increasing_id()), name)


def range_no(mid: Column | str = "_mid") -> Column:
    """The range of a row that staged_in_order has numbered."""
    return F.shiftright(F.col(mid) if isinstance(mid, str) else mid, 33)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def utf8_total(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one number, for the count of batches."""
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
