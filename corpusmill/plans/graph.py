"""Queries of the graph operators. Parts and suppliers stand for entities, their orders for connections: a surrogate of the shape alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import graph, splitting
from corpusmill.plans.inline import Inline, table

_X = "http://x.org/"
TRIPLES = Inline("building string, s string, p string, o string", (
    ("b0", f"{_X}a#e1", graph.TYPE, f"{_X}s#Fan"), ("b0", f"{_X}a#e1", graph.TYPE, f"{_X}t/Fan"), ("b0", f"{_X}a#e1", graph.TYPE, f"{_X}s#Device"), ("b0", f"{_X}a#e1", f"{_X}s#comment", "second"),
    ("b0", f"{_X}a#e1", f"{_X}s/label", "a first"), ("b0", f"{_X}a#e1", f"{_X}s#cnx", f"{_X}a/c2"), ("b0", f"{_X}a#e1", f"{_X}s#cnx", f"{_X}b/c2"), ("b0", f"{_X}a#e1", f"{_X}s#cnx", f"{_X}a/c1"),
    ("b0", f"{_X}a#e1", f"{_X}s#cnx", f"{_X}a/c1"), ("b0", f"{_X}a/e2", f"{_X}s#comment", "no type"), ("b0", f"{_X}a/e3", graph.TYPE, f"{_X}s#Fan"), ("b0", f"{_X}a/e3", f"{_X}s#hasProperty", f"{_X}a#p"),
))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all parts and suppliers; entities without a comment come from the inline rows."""
    part, item = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    uri, building = F.concat(F.lit(f"{_X}part#P"), F.col("p_partkey")), F.concat(F.lit("b"), F.col("p_partkey") % 5 + 1)
    kinds = part.select(building.alias("building"), uri.alias("s"), F.lit(graph.TYPE).alias("p"), F.concat(F.lit(f"{_X}class#"), F.col("p_type")).alias("o"))
    names = part.select(building.alias("building"), uri.alias("s"), F.lit(f"{_X}rdfs#comment").alias("p"), F.concat("p_name", F.lit(" "), F.col("p_partkey")).alias("o"))
    orders = item.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    edges = orders.select(building.alias("building"), uri.alias("s"), F.lit(f"{_X}s223#cnx").alias("p"), F.concat(F.lit(f"{_X}supplier/S"), F.col("l_suppkey")).alias("o"))
    return kinds.unionByName(names).unionByName(edges).unionByName(TRIPLES.frame(spark))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_index(_triples(spark, sf_dir))


_TYPE = f"'{graph.TYPE}'"
_PART = f"'b' || (p_partkey % 5 + 1) AS building, '{_X}part#P' || p_partkey AS s"
_LOCAL = "string_split(string_split({c}, '#')[-1], '/')[-1]"
_INDEX = f"""tr AS (SELECT {_PART}, {_TYPE} AS p, '{_X}class#' || p_type AS o FROM part
    UNION SELECT {_PART}, '{_X}rdfs#comment', p_name || ' ' || p_partkey FROM part
    UNION SELECT {_PART.replace('p_partkey', 'l_partkey')}, '{_X}s223#cnx', '{_X}supplier/S' || l_suppkey FROM lineitem
    UNION SELECT building, s, p, o FROM {TRIPLES.sql}),
  tl AS (SELECT building, s, p, o, {_LOCAL.format(c='p')} AS pl, {_LOCAL.format(c='o')} AS ol FROM tr),
  en AS (SELECT building, s AS uri, {_LOCAL.format(c='s')} AS name, list_sort(list(DISTINCT ol) FILTER (p = {_TYPE})) AS types, coalesce(min(o) FILTER (pl IN ('comment', 'label') AND o <> ''), '') AS comment,
      coalesce(list_sort(list(ol) FILTER (pl = 'cnx')), []) AS connections, coalesce(list_sort(list(ol) FILTER (pl = 'hasProperty')), []) AS properties FROM tl GROUP BY building, s HAVING count(*) FILTER (p = {_TYPE}) > 0),
  cc AS (SELECT building, class, count(*) AS n FROM (SELECT building, unnest(types) AS class FROM en) GROUP BY building, class),
  ty AS (SELECT building, 'type' AS kind, uri AS about, 'In building ''' || building || ''', what ontology class (type) is the entity described as "' || comment || '"? Answer with the class name.' AS question, 'type:' || array_to_string(types, '|') AS answer FROM en WHERE comment <> ''),
  co AS (SELECT building, 'count' AS kind, class AS about, 'In building ''' || building || ''', how many entities of ontology class ''' || class || ''' are there?' AS question, 'count:' || n AS answer FROM cc),
  cx AS (SELECT building, 'conns' AS kind, uri AS about, 'In building ''' || building || ''', what is the entity described as "' || comment || '" connected to (s223:cnx)? List the connection-point names.' AS question, 'conns:' || array_to_string(connections, '|') AS answer FROM en WHERE comment <> '' AND len(connections) > 0),
  tk AS (SELECT * FROM ty UNION ALL SELECT * FROM co UNION ALL SELECT * FROM cx)"""


def entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [F.array_join(c, "|").alias(c) for c in ("types", "connections", "properties")]
    return _entities(spark, sf_dir).select("building", "uri", "name", "comment", *lists)


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.class_counts(_entities(spark, sf_dir))


def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_classes(_entities(spark, sf_dir)).select("building", "class", "n", F.col("rank").cast("long").alias("rank"))


def building_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.building_summary(_entities(spark, sf_dir))


def mint_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_tasks(_entities(spark, sf_dir))


def mint_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.count_tasks(_entities(spark, sf_dir))


def mint_conns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connection_tasks(_entities(spark, sf_dir))


def cross_building_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = graph.minted_tasks(_entities(spark, sf_dir))
    return graph.cross_building_split(tasks).groupBy("split", "building", "kind").agg(F.count(F.lit(1)).alias("n"))


def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = graph.cross_building_split(graph.minted_tasks(_entities(spark, sf_dir)), "b1").where("split = 'test'")
    return splitting.seeded_take(tasks, 200, F.col("building"), F.col("kind"), F.col("about")).select("place", "question", "answer")


QUERIES = {f.__name__: f for f in (entity_index, class_counts, top_classes, building_summary, mint_type, mint_count, mint_conns, cross_building_split, seeded_split)}
ORACLES = {
    "entity_index": f"WITH {_INDEX} SELECT building, uri, name, comment, array_to_string(types, '|') AS types, array_to_string(connections, '|') AS connections, array_to_string(properties, '|') AS properties FROM en",
    "class_counts": f"WITH {_INDEX} SELECT building, class, n FROM cc",
    "top_classes": f"WITH {_INDEX}, r AS (SELECT *, row_number() OVER (PARTITION BY building ORDER BY n DESC, class) AS rank FROM cc) SELECT building, class, n, rank FROM r WHERE rank <= 4",
    "building_summary": f"WITH {_INDEX} SELECT building, count(*) AS n_entities, count(*) FILTER (comment <> '') AS n_comment, count(*) FILTER (len(connections) > 0) AS n_cnx FROM en GROUP BY building",
    "mint_type": f"WITH {_INDEX} SELECT * FROM ty",
    "mint_count": f"WITH {_INDEX} SELECT * FROM co",
    "mint_conns": f"WITH {_INDEX} SELECT * FROM cx",
    "cross_building_split": f"WITH {_INDEX} SELECT CASE WHEN building = (SELECT min(building) FROM tk) THEN 'test' ELSE 'train' END AS split, building, kind, count(*) AS n FROM tk GROUP BY 1, building, kind",
}
