"""Readers of JSON, folders of mixed files, run folders and manifests, all through Spark's own file sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.xlsx import workbook_text

# The order of a folder's files by suffix, and the suffixes that are reported as skipped.
TEXT_RANKS = {".ttl": 0, ".txt": 1, ".csv": 2, ".md": 3, ".xlsx": 4}
SKIPPED = (".pdf", ".png", ".jpg", ".jpeg", ".pptx", ".docx")
META = "exp string, run_id string, model string, pack string, metric string, baseline double, before double, after double, delta double, status string, started double, ended double"


def found_paths(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or pattern of paths names any file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def strict_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are nothing, a malformed one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines go; a missing file has no rows."""
    if not found_paths(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each file is one object or array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def suffix_rank(path: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for pair in TEXT_RANKS.items() for x in pair))
    return F.coalesce(ranks[suffix(path)], F.lit(9))


def valid_text(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 is replaced."""
    return F.make_valid_utf8(content.cast("string"))


def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """(building, rel_path, content) of all files below root, a building for each direct subfolder."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(re.sub(r"([][{}*?\\])", r"\\\1", root))
    base = F.regexp_extract(F.col("path"), f"\\Q{root.split('://')[-1]}\\E/(.*)$", 1)
    return files.select(F.substring_index(base, "/", 1).alias("building"), F.regexp_extract(base, "^[^/]*/(.*)$", 1).alias("rel_path"), "content").where("rel_path <> ''")


def corpus_texts(files: DataFrame, max_chars: int = 48_000) -> DataFrame:
    """(building, text, skipped, ignored): each building's files in order, joined and cut; the names of those not read.

    Files that begin beyond the cut are left out before the texts are gathered.
    """
    path = F.col("rel_path")
    known = files.withColumn("suffix", suffix(path)).withColumn("rank", suffix_rank(path))
    # Workbooks apart, as a Python function in a condition would see every file.
    books, others = known.where("suffix = '.xlsx'"), known.where("suffix <> '.xlsx'")
    bodies = others.withColumn("body", valid_text(F.col("content"))).drop("content").unionByName(books.withColumn("body", workbook_text(F.col("content"))).drop("content"))
    rows = bodies.withColumn("piece", F.when(F.col("suffix").isin(*TEXT_RANKS), F.concat(F.lit("# FILE: "), path, F.lit("\n"), F.col("body")))).drop("body")
    # A piece has its heading's ten characters at least: files beyond that many can't begin before the cut.
    order = Window.partitionBy("building").orderBy("rank", "rel_path")
    first = rows.where("piece IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_chars // 10 + 1)
    before = F.coalesce(F.sum(F.length("piece").cast("long") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rel_path", "piece"))), lambda x: x["piece"]), "\n\n")
    texts = first.withColumn("before", before).where(F.col("before") < max_chars).groupBy("building").agg(F.substring(joined, 1, max_chars).alias("text"))
    skip, name = F.col("suffix").isin(*SKIPPED), F.substring_index(path, "/", -1)
    names = rows.select("building", "rank", "rel_path", name.alias("name"), skip.alias("skip"), F.col("piece").isNull().alias("unread")).groupBy("building").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("skip"), F.struct("rank", "rel_path", "name")))), lambda x: x["name"]).alias("skipped"),
        F.array_sort(F.collect_list(F.when(~F.col("skip") & F.col("unread"), F.col("name")))).alias("ignored"),
    )
    return names.join(texts, "building", "left").select("building", F.coalesce("text", F.lit("")).alias("text"), "skipped", "ignored")


def building_names(files: DataFrame) -> DataFrame:
    """Buildings with a .ttl file; hidden, underscored and documentation folders aren't any."""
    named = files.where(~F.col("building").rlike(r"^[._]") & (F.col("building") != "documentations"))
    return named.groupBy("building").agg(F.count_if(suffix(F.col("rel_path")) == ".ttl").alias("n_ttl")).where("n_ttl > 0").select("building")


def run_metas(spark: SparkSession, root: str) -> DataFrame:
    """Meta rows of root/*/runs/*/meta.json, with their path; those that can't be read go, and without any there are no rows."""
    if not found_paths(spark, f"{root}/*/runs/*/meta.json"):
        return spark.createDataFrame([], f"{META}, path string")
    metas = spark.read.schema(f"{META}, _corrupt_record string").option("multiLine", True).json(f"{root}/*/runs/*/meta.json")
    return metas.withColumn("path", F.col("_metadata.file_path")).where("_corrupt_record IS NULL").drop("_corrupt_record")


def run_event_files(spark: SparkSession, root: str, exp: str, run_id: str, schema: str) -> DataFrame:
    """The events of one run's file, in its own schema; a run without the file has none, and malformed lines go."""
    return tolerant_json_lines(spark, f"{root}/{exp}/runs/{run_id}/events.jsonl", schema)


def manifest_documents(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, topic, text) of the manifest's good rows; a text (text_path, text) that isn't there raises when read."""
    good = manifest.where("status = 'ok' AND coalesce(text_path, '') <> ''").select("id", "topic", F.col("text_path").alias("wanted"))
    both = good.join(texts.withColumn("there", F.lit(True)), F.col("wanted") == F.col("text_path"), "left")
    text = F.when(F.col("there").isNull(), F.raise_error(F.concat(F.lit("no text at "), F.col("wanted")))).otherwise(F.col("text"))
    return both.select("id", "topic", text.alias("text"))


def first_rows(rows: DataFrame, n: int | None, row_id: str = "row_id") -> DataFrame:
    """The first n rows by their number; all for None or 0."""
    return rows.where(F.col(row_id) < n) if n else rows
