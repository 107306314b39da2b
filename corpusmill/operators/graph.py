"""Entities from RDF triples, and verifiable questions minted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# The predicate of types, and the wording of the minted questions below.
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def entity_index(triples: DataFrame) -> DataFrame:
    """(building, uri, name, types, comment, connections, properties) of every subject that has a type.

    A graph is a set, so equal triples are one; lists are in ascending order, and of several comments the least counts.
    """
    kind, o = T.local_name(F.col("p")), T.local_name(F.col("o"))
    by = triples.distinct().groupBy("building", "s").agg(
        F.array_sort(F.collect_set(F.when(F.col("p") == TYPE, o))).alias("types"),
        F.min(F.when(kind.isin("comment", "label") & (F.col("o") != ""), F.col("o"))).alias("comment"),
        F.array_sort(F.collect_list(F.when((kind == "cnx") & (F.col("p") != TYPE), o))).alias("connections"),
        F.array_sort(F.collect_list(F.when((kind == "hasProperty") & (F.col("p") != TYPE), o))).alias("properties"),
    )
    return by.where(F.size("types") > 0).select("building", F.col("s").alias("uri"), T.local_name(F.col("s")).alias("name"), "types", F.coalesce("comment", F.lit("")).alias("comment"), "connections", "properties")


def class_counts(entities: DataFrame) -> DataFrame:
    return entities.select("building", F.explode("types").alias("class")).groupBy("building", "class").agg(F.count(F.lit(1)).alias("n"))


def building_summary(entities: DataFrame) -> DataFrame:
    return entities.groupBy("building").agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("comment") != "").alias("n_comment"), F.count_if(F.size("connections") > 0).alias("n_cnx"))


def top_classes(entities: DataFrame, n: int = 4) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("building").orderBy(F.col("n").desc(), "class")
    return class_counts(entities).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _asked(building: Column, *parts: str | Column) -> Column:
    return F.concat(F.lit("In building '"), building, F.lit("', "), *(F.lit(p) if isinstance(p, str) else p for p in parts))


def type_tasks(entities: DataFrame) -> DataFrame:
    asked = _asked(F.col("building"), "what ontology class (type) is the entity described as \"", F.col("comment"), "\"? Answer with the class name.")
    rows = entities.where((F.size("types") > 0) & (F.col("comment") != ""))
    return rows.select("building", F.lit("type").alias("kind"), F.col("uri").alias("about"), asked.alias("question"), F.concat(F.lit("type:"), F.array_join("types", "|")).alias("answer"))


def count_tasks(entities: DataFrame) -> DataFrame:
    asked = _asked(F.col("building"), "how many entities of ontology class '", F.col("class"), "' are there?")
    return class_counts(entities).select("building", F.lit("count").alias("kind"), F.col("class").alias("about"), asked.alias("question"), F.concat(F.lit("count:"), F.col("n")).alias("answer"))


def connection_tasks(entities: DataFrame) -> DataFrame:
    asked = _asked(F.col("building"), "what is the entity described as \"", F.col("comment"), "\" connected to (s223:cnx)? List the connection-point names.")
    rows = entities.where((F.size("connections") > 0) & (F.col("comment") != ""))
    return rows.select("building", F.lit("conns").alias("kind"), F.col("uri").alias("about"), asked.alias("question"), F.concat(F.lit("conns:"), F.array_join("connections", "|")).alias("answer"))


def minted_tasks(entities: DataFrame) -> DataFrame:
    return type_tasks(entities).unionByName(count_tasks(entities)).unionByName(connection_tasks(entities))


def cross_building_split(tasks: DataFrame, holdout: str | None = None) -> DataFrame:
    """With split: test for the held-out building (without a name: the first), train for the rest."""
    if holdout is not None:
        return tasks.withColumn("split", F.when(F.col("building") == holdout, "test").otherwise("train"))
    first = tasks.agg(F.min("building").alias("first_building"))  # one row
    return tasks.join(F.broadcast(first)).withColumn("split", F.when(F.col("building") == F.col("first_building"), "test").otherwise("train")).drop("first_building")
