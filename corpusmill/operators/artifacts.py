"""Content-addressed dataset artifacts: data, provenance, and a pointer to the latest.

Paths go through Spark's file systems, so an artifact may be in any store that Spark writes to.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dataset_id(spec: dict) -> str:
    """12 hex digits of the spec's canonical JSON: the same for any order of its keys."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def dataset_id_of(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, 12)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def artifact_path(root: str, spec: dict) -> str:
    return f"{root}/data/{dataset_id(spec)}"


def exists(spark: SparkSession, root: str, spec: dict) -> bool:
    return _exists(spark, f"{artifact_path(root, spec)}/data.jsonl/_SUCCESS")


def write(root: str, spec: dict, rows: DataFrame, stats: dict | None = None) -> str:
    """Writes rows, then provenance, then the pointer; returns the folder. Rows are counted as they are written."""
    from pyspark.sql import Observation

    spark, path, seen = rows.sparkSession, artifact_path(root, spec), Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/data.jsonl")
    made = json.dumps({"dataset_id": dataset_id(spec), "spec": spec, "n": seen.get["n"], "stats": stats or {}, "built": time.time()})
    for text, name in ((made, f"{path}/provenance.json"), (dataset_id(spec), f"{root}/data/LATEST")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(name)
    return path


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/data.jsonl")


def provenance(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/provenance.json").first()[0])


def latest(spark: SparkSession, root: str) -> str | None:
    """The folder that the pointer names, or None without it or its data."""
    if not _exists(spark, f"{root}/data/LATEST"):
        return None
    path = f"{root}/data/{spark.read.text(f'{root}/data/LATEST').first()[0].strip()}"
    return path if _exists(spark, f"{path}/data.jsonl/_SUCCESS") else None


def cached(spark: SparkSession, root: str, spec: dict, build: Callable[[], DataFrame], stats: Callable[[DataFrame], dict] | None = None) -> str:
    """The artifact's folder, built if it isn't there; what is there stays, and the pointer with it."""
    if exists(spark, root, spec):
        return artifact_path(root, spec)
    rows = build()
    return write(root, spec, rows, stats(rows) if stats else None)


def write_exam(rows: DataFrame, path: str, again: bool = False) -> None:
    """Writes a frozen exam once; a second time only if asked to."""
    rows.write.mode("overwrite" if again else "errorifexists").json(path)


def write_split(docs: DataFrame, path: str, provenance_row: DataFrame) -> None:
    """train and heldout as JSON lines below path, from (…, heldout), and the provenance; docs should be staged, as it is read twice."""
    for name, rows in (("train.jsonl", docs.where("NOT heldout")), ("heldout.jsonl", docs.where("heldout"))):
        rows.drop("heldout").write.mode("overwrite").json(f"{path}/{name}")
    provenance_row.coalesce(1).write.mode("overwrite").json(f"{path}/provenance.json")


def write_index(entities: DataFrame, path: str) -> None:
    """Entities, a folder for each building."""
    entities.write.mode("overwrite").partitionBy("building").parquet(path)


def load_index(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The index at path, built first if it isn't there."""
    if rebuild or not _exists(spark, f"{path}/_SUCCESS"):
        write_index(build(), path)
    return spark.read.parquet(path)


def best_checkpoint(pointer: DataFrame | None, explicit: str | None = None) -> str:
    """The explicit path, else that of the one-row pointer (stage, metric, value, path); without either an error."""
    if explicit:
        return explicit
    row = pointer.select("path").first() if pointer is not None else None
    if row is None:
        raise FileNotFoundError("no best checkpoint")
    return row["path"]
