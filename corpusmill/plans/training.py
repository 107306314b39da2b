"""Queries of whole flows: grounded training rows, corpus quizzes, augmentation, run details, and graphs read from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import gating, retrieval, telemetry
from corpusmill.operators.staging import shared_path, staged
from corpusmill.plans import cleaning, runs
from corpusmill.plans.grading import _PROMPT, _anchor_sql
from corpusmill.plans.inline import table
from corpusmill.sources import files, triples


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as authored questions about sources; their anchors are the first six distinct words of four letters. Even ones are cached, in all sources but src0."""
    words = F.array_distinct(F.filter(F.split("text", r"[\s.,]+", -1), lambda w: w.rlike(r"^[A-Za-z]{4,}\z")))
    rows = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("building"), F.col("item_id").cast("string").alias("id"), F.lit("find").alias("intent"), F.lit("engineer").alias("persona"),
        F.lit("benchmark").alias("source"), F.col("text").alias("question"), F.slice(words, 1, 6).alias("anchors"),
    )
    return gating.authored(rows.where("building <> 'src0' AND id % 2 = 0"), rows)


def _grounded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = staged(_items(spark, sf_dir), "items")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus_id"), F.col("doc_id").alias("rank"), "text")
    heads = retrieval.corpus_heads(docs, retrieval.BUDGET)
    return items, gating.grounded_training(items, cleaning._chunks(spark, sf_dir), heads, "sys", lambda prompt: F.right(prompt, F.lit(4000)))


def grounded_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in for a generator answers with the prompt's last 4,000 characters."""
    _, kept = _grounded(spark, sf_dir)
    return kept.select("building", "id", "n_anchors", F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|")).alias("chat_md5"))


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, kept = _grounded(spark, sf_dir)
    return gating.gate_counts(items, kept)


def _quiz_reply(prompt: Column) -> Column:
    """Every third passage length has three choices, every fifth no reply that can be read."""
    n = F.length(prompt)
    choices = F.when(n % 3 == 0, '["a", "b", "c"]').otherwise('["a", "b", "c", "d"]')
    return F.when(n % 5 == 0, "sorry").otherwise(F.concat(F.lit('Here: {"q": "of '), n, F.lit('?", "choices": '), choices, F.lit(', "answer": "B"} end')))


def corpus_quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), "text")
    found = gating.corpus_quiz(docs, _quiz_reply, n=100, windows=2)
    return found.select("id", "topic", "q", F.array_join("choices", "|").alias("choices"), "answer", "src")


def augment_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature's limit: the first 50 documents. The stand-in paraphrases a body by its length."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), "text").withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0"))
    found = gating.augment(docs, lambda body: F.concat(F.lit('{"paraphrases": ["of '), F.length(body), F.lit(' characters"], "qa": []}')), n=50)
    return found.select("id", "topic", F.md5("text").alias("text_md5"), "in_chars", "ok")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user: a row when it starts, and one when it ends, but for every tenth."""
    user, seen = F.col("user_id"), F.when(F.col("value").isNotNull(), F.col("event_id"))
    both = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", seen).alias("baseline"), F.max_by("value", seen).alias("after"), F.min("event_id").alias("started"), F.max("event_id").alias("ended"))
    meta = both.select(F.lit("e").alias("exp"), user.cast("string").alias("run_id"), F.when(user % 3 != 0, F.col("baseline")).alias("baseline"), "after", "started", "ended")
    begun = meta.withColumns({"after": F.lit(None).cast("double"), "ended": F.lit(None).cast("long"), "status": F.lit("running"), "delta": F.lit(None).cast("double"), "updated": F.col("started")})
    return begun.unionByName(telemetry.finished(meta.where("run_id % 10 <> 0")).withColumn("updated", F.col("ended") + 1))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.latest_meta(_updates(spark, sf_dir)).select("exp", "run_id", "status", "delta", "started", "ended")


def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users 1 to 7 are missing: their runs have no step."""
    meta = telemetry.latest_meta(_updates(spark, sf_dir)).select("exp", "run_id", "status")
    events = runs._events(spark, sf_dir).where("CAST(run_id AS int) NOT BETWEEN 1 AND 7").select("exp", "run_id", "step", "t")
    return telemetry.run_details(meta, events)


def turtle_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as Turtle, a file for each class, with a base, and read again as triples."""
    part = table(spark, sf_dir, "part")
    line = F.concat(F.lit("<P"), F.col("p_partkey"), F.lit("> a c:"), F.regexp_replace("p_type", "[^A-Za-z0-9]", "_"), F.lit(' ; rdfs:label "'), F.col("p_name"), F.lit('" , "size '), F.col("p_size"), F.lit('"@en .'))
    head = "@base <http://x.org/part/list> .\n@prefix c: <http://x.org/class#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
    root, kind = shared_path(spark, "turtle"), F.regexp_replace("p_type", "[^A-Za-z0-9]", "_")
    texts = part.select(kind.alias("kind"), F.concat(F.lit(head), line).alias("value"))
    texts.write.partitionBy("kind").option("lineSep", "\n\n").text(root)
    found = files.folder_files(spark, root).where("rel_path LIKE '%.txt'")
    # A class's file holds its header once for each part: @base and @prefix may stand anywhere.
    return triples.triples(triples.parsed_files(found)).select(F.expr("substring(building, 6)").alias("kind"), "s", "p", "o")


_RUN_META = """b AS (SELECT user_id, arg_min(value, event_id) AS baseline, arg_max(value, event_id) AS after, min(event_id) AS started, max(event_id) AS ended FROM events GROUP BY user_id),
  m AS (SELECT 'e' AS exp, user_id::VARCHAR AS run_id, CASE WHEN user_id % 10 = 0 THEN 'running' ELSE 'done' END AS status,
          CASE WHEN user_id % 10 <> 0 AND user_id % 3 <> 0 THEN round_even(after - baseline, 4) END::DOUBLE AS delta, started, CASE WHEN user_id % 10 <> 0 THEN ended END AS ended FROM b)"""
_ITEMS = r"""it AS (SELECT 'src' || (item_id % 20) AS building, item_id AS id, text AS question, list_distinct_in_order AS anchors FROM (SELECT *, [w FOR w, i IN words IF list_position(words, w) = i][1:6] AS list_distinct_in_order
    FROM (SELECT *, [w FOR w IN string_split_regex(text, '[\s.,]+') IF regexp_full_match(w, '[A-Za-z]{4,}')] AS words FROM benchmark))),
  cached AS (SELECT DISTINCT 'src' || (item_id % 20) AS building FROM benchmark WHERE item_id % 20 <> 0 AND item_id % 2 = 0),
  ai AS (SELECT * FROM it WHERE (building <> 'src0' AND id % 2 = 0) OR building NOT IN (SELECT building FROM cached))"""
_KEPT = rf"""{cleaning._SLICES.format(chunks=cleaning._DOC_CHUNKS, asked=cleaning._ASKED, budget=retrieval.BUDGET)}, {_ITEMS},
  sl2 AS (SELECT ai.*, an.slice, [a FOR a IN anchors IF {_anchor_sql('a', 'an.slice')}] AS in_slice FROM ai JOIN an ON an.question_id = ai.id),
  pr2 AS (SELECT *, {_PROMPT.format(c='slice', q='question')} AS prompt FROM sl2 WHERE len(in_slice) >= 2),
  an2 AS (SELECT *, regexp_replace(right(prompt, 4000), '^\s+|\s+$', '', 'g') AS answer FROM pr2),
  kept AS (SELECT * FROM an2 WHERE answer <> '' AND len([a FOR a IN in_slice IF {_anchor_sql('a', 'answer')}]) >= greatest(2, ceil(0.8 * len(in_slice))))"""
_KIND = "regexp_replace(p_type, '[^A-Za-z0-9]', '_', 'g')"

QUERIES = {f.__name__: f for f in (grounded_training, gate_counts, corpus_quiz, augment_first, run_status, run_details, turtle_graph)}
ORACLES = {
    "grounded_training": f"{_KEPT} SELECT building, id::VARCHAR AS id, len(in_slice)::BIGINT AS n_anchors, md5('sys|' || prompt || '|' || answer) AS chat_md5 FROM kept",
    "gate_counts": f"""{_KEPT} SELECT building, count(*) AS authored, count(*) FILTER (id IN (SELECT id FROM kept)) AS kept, count(*) FILTER (id NOT IN (SELECT id FROM kept)) AS dropped FROM ai GROUP BY building""",
    "corpus_quiz": rf"""WITH o AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER () // 100) AS step FROM documents),
      s AS (SELECT doc_id, source, text, i // step AS j FROM o WHERE i % step = 0 AND i < step * 100),
      p AS (SELECT doc_id, source, j, w, regexp_replace(substr(text, (w * 1800 + 1)::BIGINT, 1800), '^\s+|\s+$', '', 'g') AS passage FROM s, (SELECT unnest([0, 1])::BIGINT AS w)),
      n AS (SELECT *, length(passage) + 9 AS n FROM p WHERE length(passage) >= 400)
      SELECT 'cq-' || lpad(j::BIGINT::VARCHAR, greatest(3, length(j::BIGINT::VARCHAR))::INT, '0') || '-' || w AS id, source AS topic, 'of ' || n || '?' AS q, 'a|b|c|d' AS choices, 'B' AS answer, doc_id AS src FROM n WHERE n % 5 <> 0 AND n % 3 <> 0""",
    "augment_first": r"""WITH d AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, source AS topic, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents ORDER BY doc_id LIMIT 50)
      SELECT id || '-aug' AS id, topic, md5(body || chr(10) || chr(10) || 'of ' || length(body) || ' characters') AS text_md5, length(body)::BIGINT AS in_chars, true AS ok FROM d""",
    "run_status": f"WITH {_RUN_META} SELECT exp, run_id, status, delta, started, ended FROM m",
    "run_details": f"""WITH {_RUN_META}, e AS (SELECT user_id::VARCHAR AS run_id, event_id AS step, floor(epoch(ts))::DOUBLE AS t FROM events WHERE user_id NOT BETWEEN 1 AND 7)
      SELECT exp, m.run_id, status, step, t FROM m LEFT JOIN e ON e.run_id = m.run_id""",
    "turtle_graph": f"""SELECT {_KIND} AS kind, 'http://x.org/part/P' || p_partkey AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://x.org/class#' || {_KIND} AS o FROM part
      UNION SELECT {_KIND}, 'http://x.org/part/P' || p_partkey, 'http://www.w3.org/2000/01/rdf-schema#label', p_name FROM part
      UNION SELECT {_KIND}, 'http://x.org/part/P' || p_partkey, 'http://www.w3.org/2000/01/rdf-schema#label', 'size ' || p_size FROM part""",
}
