"""Queries of the grading, gating, evaluation and rendering operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import evaluation, gating, grading
from corpusmill.operators.artifacts import dataset_id_of
from corpusmill.plans.inline import Inline, table

NUMBERS = Inline("id long, prediction string, gold string", (
    (1, "so #### 1,234.", "#### 1234"), (2, "the total is 7", "#### 7"), (3, "#### ", "#### 3"), (4, "it is -3", "#### -3"), (5, "5-3", "#### -3"),
    (6, "5.0", "#### 5"), (7, "no number", "#### 1"), (8, "#### 9 apples", "#### 8"), (9, "1 #### 2 #### 3", "#### 3"), (10, "", "none"), (11, "costs 12.50 or 1,000,000.", "#### 1000000"),
))
TAGGED = Inline("id long, prediction string, gold string", (
    (1, "It is an AHU.", "type:AHU|Fan"), (2, "a fan-coil", "type:Coil|Pump"), (3, "none", "type:AHU"), (4, "there are 5", "count:5"), (5, "5 of 05", "count:5"), (6, "no", "count:0"),
    (7, "Zone_1 and zone 2", "conns:zone-1|zone-2"), (8, "zone 1", "conns:zone-1|zone-2"), (9, "nothing", "conns:zone-1"), (10, "x", "conns:"), (11, "!!", "type:?"), (12, "any", "conns: |a b"),
    (13, "AHU", "AHU"),
))
ANCHORS = Inline("id long, anchor string, answer string", (
    (1, "21", "set to 21.5"), (2, "21", "121 units"), (3, "21", "about 21, or so"), (4, "21.5", "at 21.5"), (5, "a/b/log.csv", "see LOG.csv there"), (6, "a/b.c", "see b.c"),
    (7, "x/ab", "ab is short"), (8, "AHU_01-SF", "the AHU 01-SF fan"), (9, "supply air fan", "supply fan of air"), (10, "supply air fan", "air fan"), (11, "supply air fan", "the supply of fans"),
    (12, "  ", "x"), (13, "Supply Air", "SUPPLY   AIR temp"), (14, "-4", "at -4 degrees"), (15, "notes.md", "in Notes.MD"), (16, "two words", "two things"), (17, "??", "??"),
))
VERDICTS = Inline("id string, intent string, anchors array<string>, reply string", (
    ("a", "find", ["x", "y"], 'Sure: {"matched": ["x"], "missed": ["y"], "contradiction": false} ok'), ("b", "find", ["x"], '{"matched": ["x"], "contradiction": true}'),
    ("c", "why", ["x", "y", "z"], '{"matched": ["x"], "contradiction": true}'), ("d", "why", ["x", "y"], '{"matched": ["x", "x", "x"], "missed": []}'), ("e", "why", ["x"], '{"matched": ["q"]}'),
    ("f", None, [], '{"matched": []}'), ("g", "find", ["x"], "{broken"), ("h", "find", ["x"], "no json"), ("i", "find", ["x", "y", "z"], '{"matched": ["x", "z"]}'),
))
CHOICES = Inline("id string, topic string, q string, choices array<string>, answer string, reply string", (
    ("1", "hvac", "Which?", ["a", "b", "c", "d"], "B", "B"), ("2", "hvac", "What?", ["a", "b", "c", "d"], "B", "b."), ("3", "fdd", "Who?", ["a", "b", "c", "d"], "B", "The answer is B"),
    ("4", "fdd", "How?", ["a", "b", "c"], "A", ""), ("5", "bas", "When?", ["a", "b", "c", "d"], "", "xyz"), ("6", "bas", "Why?", ["a", "b", "c", "d"], "BC", "D"), ("7", "bas", "So?", ["a", "b", "c", "d"], None, "C"),
))
GATES = Inline("id string, question string, anchors array<string>, slice string, answer string", (
    ("one", "q", ["alpha"], "alpha beta", "alpha"), ("two", "q", ["alpha", "beta"], "alpha beta", "beta and alpha"), ("half", "q", ["alpha", "beta"], "alpha beta", "alpha"),
    ("five", "q", ["alpha", "beta", "gamma", "delta", "omega"], "alpha beta gamma delta omega", "alpha beta gamma delta"), ("five-", "q", ["alpha", "beta", "gamma", "delta", "omega"], "alpha beta gamma delta omega", "alpha beta gamma"),
    ("six", "q", ["alpha", "beta", "gamma", "delta", "omega", "sigma"], "alpha beta gamma delta omega sigma", "alpha beta gamma delta"), ("blank", "q", ["alpha", "beta"], "alpha beta", " \n "), ("out", "q", ["alpha", "kappa", "beta"], "alpha beta", " beta alpha "),
    ("none", "q", [], "alpha", "alpha"),
))
SAMPLES = Inline("id long, sample long, prediction string, gold string", tuple((i, s, f"so {i * s} #### {i + s}", f"#### {i + 2}") for i in range(1, 6) for s in range(1, 5)))
REPLIES = Inline("id long, reply string", (
    (1, '```json\n[{"question":"q1","answer":"a1","anchors":["x"]}]\n```'), (2, 'Here: [{"question":"q1","answer":"a1","anchors":["x"]},{"question":"q2","answer":"a2","anchors":["y","z"]},{"question":"q3","ans'),
    (3, '[{"question":"q1","answer":"a1","anchors":["x"]}, 7, "s", {"question":"q2","answer":"a2"}]'), (4, "nothing here"), (5, '[{"question":"","answer":"a","anchors":["x"]}]'), (6, "[]"),
    (7, '[{"question":"q1","answer":"a1","anchors":[]}]'),
))
#: What the reply parser must find: SQL has no way to drop single elements of a malformed array, so these are stated.
PARSED = Inline("id long, n_items long, questions string", ((1, 1, "q1"), (2, 2, "q1,q2"), (3, 1, "q1"), (4, 0, ""), (5, 0, ""), (6, 0, ""), (7, 0, "")))
ITEMS = Inline("id string, persona string, intent string, question string, answer string, anchors array<string>, source string", (
    ("abc-00", "engineer", "find", "q0", "a0", ["x", "y"], "a.ttl"), ("abc-01", None, "why", "q1", None, ["z"], None), ("abd-00", "operator", "find", "q2", "a2", ["x"], "b.csv"),
))


_NUM = "rtrim(replace(list_extract(regexp_extract_all(string_split({c}, '####')[-1], '-?\\d[\\d,]*\\.?\\d*'), -1), ',', ''), '.')"
_NORM = r"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_ANORM = r"trim(regexp_replace(regexp_replace(replace(lower({c}), '_', ' '), '[^a-z0-9./:\- ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _anchor_sql(a: str, t: str) -> str:
    s, na, nt = _STRIP.format(c=a), _ANORM.format(c=_STRIP.format(c=a)), _ANORM.format(c=t)
    base = _ANORM.format(c=f"string_split({s}, '/')[-1]")
    words = f"[w FOR w IN string_split({na}, ' ') IF length(w) >= 2]"
    return rf"""CASE WHEN {na} = '' THEN false
      WHEN regexp_full_match({s}, '-?\d+(\.\d+)?') THEN regexp_matches({t}, '(^|[^0-9.])' || replace({s}, '.', '\.') || '([^0-9.]|$)')
      WHEN contains({s}, '/') OR regexp_matches({s}, '\.(txt|ttl|csv|md|pdf|png)$') THEN contains({nt}, {na}) OR (length({base}) >= 4 AND contains({nt}, {base}))
      WHEN contains({nt}, {na}) THEN true
      ELSE len({words}) >= 2 AND contains({nt}, {words}[1]) AND len([w FOR w IN {words} IF contains({nt}, w)]) >= greatest(2, len({words}) - 1) END"""


def gsm_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prediction"))
    rows = docs.unionByName(NUMBERS.frame(spark).select((-F.col("id")).alias("doc_id"), "prediction"))
    return rows.select("doc_id", T.final_number(F.col("prediction")).alias("number"))


def gsm_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for predictions: a third of them have their own text as gold, the others a digit."""
    p, g, n = F.col("prediction"), F.col("gold"), F.col("doc_id")
    gold = F.when(n % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("#### "), n % 10))
    rows = table(spark, sf_dir, "documents").select(n.alias("id"), F.col("text").alias("prediction"), gold.alias("gold"))
    rows = rows.unionByName(NUMBERS.frame(spark).withColumn("id", -F.col("id")))
    return rows.select("id", grading.number_correct(p, g).alias("ok"), grading.number_reward(p, g).alias("reward"))


def building_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = F.col("prediction"), F.col("gold")
    return TAGGED.frame(spark).select("id", grading.tagged_kind(g).alias("kind"), grading.tagged_reward(p, g).cast("double").alias("reward"), grading.tagged_correct(p, g).alias("ok"))


def anchor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    pairs = talk.select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("id"), F.regexp_extract("text", r"^(\S+ \S+)", 1).alias("anchor"), F.lower("text").alias("answer"))
    rows = pairs.unionByName(ANCHORS.frame(spark))
    return rows.select("id", T.anchor_in(F.col("anchor"), F.col("answer")).alias("found"))


def anchor_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    words = F.slice(F.filter(F.split("text", r"[\s.,]+", -1), lambda w: w.rlike(r"^[A-Za-z]{4,}\z")), 1, 4)
    rows = talk.select("conv_id", "turn", "text", F.concat(words, F.array(F.lit("absent anchor"))).alias("anchors"))
    return rows.select("conv_id", "turn", F.round(grading.anchor_reward(F.col("anchors"), F.col("text")), 9).alias("reward"))


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a slice, its five longest words and one that is absent the anchors, its first 400 characters the answer to a benchmark item."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![^\s.,])[A-Za-z]{4,}+(?![^\s.,])"), F.lit(0)))
    longest = F.slice(F.sort_array(F.transform(words, lambda w: F.concat(F.lpad((100_000 - F.length(w)).cast("string"), 6, "0"), w))), 1, 5)
    anchors = F.concat(F.transform(longest, lambda w: F.substring(w, F.lit(7), F.length(w))), F.array(F.lit("absent anchor")))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("asked"))
    docs = table(spark, sf_dir, "documents").join(asked, F.col("doc_id") % 50 == F.col("item"), "left")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("asked", F.lit("")).alias("question"), anchors.alias("anchors"), F.col("text").alias("slice"), F.substring("text", 1, 400).alias("answer"))
    return rows.unionByName(GATES.frame(spark))


def grounding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gates(spark, sf_dir).select("*", *(F.lit(None).cast("string").alias(c) for c in ("intent", "persona", "source")))
    found = gating.grounding_gate(rows, "Answer from the data.")
    return found.select("id", "intent", "n_anchors", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("chat"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents by source: a good one's verdict matches both anchors, another's one, a toxic one contradicts, every seventh can't be read."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    matched = F.concat(F.lit('{"matched": ["'), F.col("source"), F.when(F.col("quality") == 1, F.concat(F.lit('", "'), F.col("lang"))).otherwise(""), F.lit('"], "contradiction": '))
    reply = F.when(F.col("doc_id") % 7 == 0, "sorry").otherwise(F.concat(matched, F.when(F.col("toxic") == 1, "true").otherwise("false"), F.lit("}")))
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("intent"), F.array("source", "lang").alias("anchors"), reply.alias("reply"))
    return rows.unionByName(VERDICTS.frame(spark))


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir)
    strict = grading.judged(rows, rows, strict=True).select("id", F.col("score").alias("strict_score"))
    return grading.judged(rows, rows).join(strict, "id")


def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir)
    return evaluation.judge_summary(grading.judged(rows, rows)).withColumn("judge_score", F.round("judge_score", 9))


def judge_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents by source: quality labels stand for verdicts."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluation.judge_by_intent(docs.select(F.col("source").alias("intent"), F.col("quality").cast("double").alias("score"))).withColumn("mean_score", F.round("mean_score", 9))


def mcq_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CHOICES.frame(spark).select("id", grading.choice_letter(F.col("reply")).alias("letter"), T.choices_prompt(F.col("q"), F.col("choices")).alias("prompt"))


def mcq_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = CHOICES.frame(spark).withColumn("ok", F.coalesce(grading.choice_letter(F.col("reply")) == F.col("answer"), F.lit(False)))
    return evaluation.with_total(rows, "ok", "topic")


def mcq_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, a = F.col("choices"), F.col("answer")
    return CHOICES.frame(spark).select("id", grading.choices_valid(c, a).alias("valid"), grading.choices_valid(c, a, strict=True).alias("strictly_valid"))


def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("answer"))
    return evaluation.majority_baseline(rows).withColumn("accuracy", F.round("accuracy", 9))


def accuracy_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TAGGED.frame(spark).select(grading.tagged_kind(F.col("gold")).alias("kind"), grading.tagged_correct(F.col("prediction"), F.col("gold")).alias("ok"))
    return evaluation.accuracy(rows, "ok", "kind").withColumn("accuracy", F.round("accuracy", 9))


def parse_llm_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VERDICTS.frame(spark).select("id", T.json_object_text(F.col("reply")).alias("object_text"), grading.verdict(F.col("reply")).isNotNull().alias("parsed"))


def parse_llm_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = REPLIES.frame(spark).withColumn("items", gating.parse_items(F.col("reply")))
    return found.select("id", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x["question"]), ",").alias("questions"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a generator: every third document has no readable reply."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("topic"), "text", "doc_id")
    reply = F.concat(F.lit('ok {"paraphrases": ["in other words '), F.col("doc_id"), F.lit('", " "], "qa": [{"q": "which?", "a": "'), F.col("topic"), F.lit('"}, {"q": "", "a": "x"}]}'))
    return docs.withColumn("reply", F.when(F.col("doc_id") % 3 == 0, "sorry").otherwise(reply)).drop("doc_id")


def augment_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.augmented(_replies(spark, sf_dir)).select("id", "topic", F.md5("text").alias("text_md5"), "in_chars", "ok")


def augmentation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.augmentation_ratio(gating.augmented(_replies(spark, sf_dir))).withColumn("ratio", F.round("ratio", 9))


def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat rows, in order of their turns."""
    talk = table(spark, sf_dir, "conversations")
    chat = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    rows = talk.groupBy("conv_id").agg(chat.alias("messages"))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "\n")).alias("content_md5"))


def sft_render_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.grounded_prompt(F.lit("ctx"), F.col("text")).alias("prompt"), F.md5("text").alias("gold"))
    chat = T.messages(system=F.lit("sys"), user=F.col("prompt"), assistant=F.col("gold"))
    return rows.select("item_id", F.md5(F.array_join(F.transform(chat, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).alias("chat_md5"))


def reward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gating.reward_rows(_gates(spark, sf_dir), "sys")
    return found.select("id", F.array_join("anchors", "|").alias("anchors"), F.size("messages").cast("long").alias("n_messages"))


def minted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", gating.minted_id(F.col("source"), F.col("doc_id")).alias("minted"), gating.quiz_id(F.col("doc_id"), F.lit(1)).alias("quiz_id"), F.md5(gating.with_terminator(F.col("text"), "<end>")).alias("ended_md5"))


def quiz_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.quiz_counts(CHOICES.frame(spark))


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the first good and the first other document by label, as a preferred and a rejected text."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select("source", F.md5("text").alias("text"), (F.col("quality") == 1).alias("good"))
    return gating.preference_pairs(rows, "source", "text", "good")


def rejection_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.rejection_sample(SAMPLES.frame(spark)).select("id", "sample", "prediction")


def exam_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.exam_rows(ITEMS.frame(spark)).withColumn("anchors", F.array_join("anchors", "|"))


def intent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.intent_counts(ITEMS.frame(spark))


def backend_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lower("n_name"), F.lit(":m:"), F.col("n_nationkey")).alias("backend"))
    provider, model = gating.backend_parts(F.col("backend"))
    return rows.select("backend", provider.alias("provider"), model.alias("model"))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for documents: the value is the loss, a number derived from the id the tokens."""
    rows = table(spark, sf_dir, "events").select((F.col("value") / 10).alias("loss"), (F.col("event_id") % 50).alias("n_tokens"))
    return evaluation.perplexity(rows).withColumn("perplexity", F.round("perplexity", 6))


def dataset_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat(F.lit('{"k":'), F.col("doc_id"), F.lit(',"source":"'), F.col("source"), F.lit('"}'))
    return table(spark, sf_dir, "documents").select("doc_id", dataset_id_of(spec).alias("dataset_id"))


_JSON = r"nullif(regexp_extract(reply, '(?s)\{.*\}', 0), '')"
# Whole tables and the inline rows.
_ALL_NUMBERS = f"(SELECT doc_id AS id, text AS prediction, CASE WHEN doc_id % 3 = 0 THEN text ELSE '#### ' || (doc_id % 10) END AS gold FROM documents UNION ALL SELECT -id, prediction, gold FROM {NUMBERS.sql})"
_WORDS = r"list_distinct([w FOR w IN string_split_regex(text, '[\s.,]+') IF regexp_full_match(w, '[A-Za-z]{4,}')])"
_ALL_GATES = f"""(SELECT doc_id::VARCHAR AS id, coalesce(asked, '') AS question,
      list_concat([substr(x, 7) FOR x IN list_sort([lpad((100000 - length(w))::VARCHAR, 6, '0') || w FOR w IN {_WORDS}])[1:5]], ['absent anchor']) AS anchors, text AS slice, substr(text, 1, 400) AS answer
      FROM documents LEFT JOIN (SELECT item_id, text AS asked FROM benchmark) ON doc_id % 50 = item_id UNION ALL SELECT id, question, anchors, slice, answer FROM {GATES.sql})"""
_ALL_VERDICTS = f"""(SELECT doc_id::VARCHAR AS id, source AS intent, [source, lang] AS anchors, CASE WHEN doc_id % 7 = 0 THEN 'sorry'
      ELSE '{{"matched": ["' || source || CASE WHEN quality = 1 THEN '", "' || lang ELSE '' END || '"], "contradiction": ' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END || '}}' END AS reply
      FROM documents JOIN labels USING (doc_id) UNION ALL SELECT id, intent, anchors, reply FROM {VERDICTS.sql})"""
_JUDGED = f"""v AS (SELECT id, coalesce(intent, '') AS intent, anchors, CASE WHEN json_valid({_JSON}) THEN {_JSON}::JSON END AS j FROM {_ALL_VERDICTS}),
  m AS (SELECT id, intent, anchors, j, coalesce((j->'matched')::VARCHAR[], []) AS matched, coalesce((j->>'contradiction')::BOOLEAN, false) AS wrong FROM v),
  s AS (SELECT id, intent, j IS NULL AS error, wrong, len([x FOR x IN matched IF list_contains(anchors, x)]) / greatest(1, len(anchors)) AS raw,
               len([x FOR x IN list_distinct(matched) IF list_contains(anchors, x)]) / greatest(1, len(anchors)) AS strict_raw FROM m),
  c AS (SELECT id, intent, error, CASE WHEN error THEN 0.0 WHEN wrong THEN least(raw, 0.5) ELSE raw END::DOUBLE AS score, CASE WHEN error THEN 0.0 WHEN wrong THEN least(strict_raw, 0.5) ELSE strict_raw END::DOUBLE AS strict_score FROM s),
  r AS (SELECT *, round_even(score, 3)::DOUBLE AS score_rounded FROM c)"""
_EXPECTED = f"[{_NORM.format(c='x')} FOR x IN string_split(body, '|') IF {_STRIP.format(c='x')} <> '']"
_TAGGED = f"""t AS (SELECT id, prediction, string_split(gold, ':')[1] AS kind, CASE WHEN contains(gold, ':') THEN substr(gold, instr(gold, ':') + 1) ELSE '' END AS body FROM {TAGGED.sql}),
  e AS (SELECT *, {_EXPECTED} AS expected, ' ' || {_NORM.format(c="prediction")} || ' ' AS said FROM t),
  h AS (SELECT *, len([x FOR x IN expected IF contains(said, ' ' || x || ' ')]) AS hits FROM e),
  w AS (SELECT id, kind, CASE WHEN kind = 'count' THEN CASE WHEN coalesce(list_extract(regexp_extract_all(prediction, '-?\\d+'), -1) = body, false) THEN 1.0 ELSE 0.0 END
          WHEN len(expected) = 0 THEN 0.0 WHEN kind = 'type' THEN CASE WHEN hits >= 1 THEN 1.0 ELSE 0.0 END ELSE hits / len(expected) END::DOUBLE AS reward FROM h)"""
_GATED = f"""g AS (SELECT *, [a FOR a IN anchors IF {_anchor_sql('a', 'slice')}] AS in_slice FROM {_ALL_GATES}),
  k AS (SELECT *, len([a FOR a IN in_slice IF {_anchor_sql('a', 'answer')}]) AS stated FROM g WHERE len(in_slice) >= 2)"""
_PROMPT = "'Use only the building''s data below to answer.' || chr(10) || chr(10) || '--- BUILDING DATA ---' || chr(10) || {c} || chr(10) || '--- END BUILDING DATA ---' || chr(10) || chr(10) || 'Question: ' || {q}"
_AUGMENTED = rf"""d AS (SELECT doc_id, source AS topic, {_STRIP.format(c="text")} AS body FROM documents),
  a AS (SELECT doc_id, topic, body, doc_id % 3 <> 0 AS ok, CASE WHEN doc_id % 3 = 0 THEN body ELSE body || chr(10) || chr(10) || 'in other words ' || doc_id || chr(10) || chr(10) || 'Q: which?' || chr(10) || 'A: ' || topic END AS text FROM d)"""

QUERIES = {f.__name__: f for f in (
    gsm_extract, gsm_reward, building_reward, anchor_match, anchor_reward, grounding_gate, judge_scores, judge_summary, judge_by_intent, mcq_parse, mcq_accuracy, mcq_validity, majority_baseline,
    accuracy_by_kind, parse_llm_object, parse_llm_array, augment_docs, augmentation_ratio, sft_messages, sft_render_gold, preference_pairs, rejection_sample, exam_rows, intent_counts, backend_parts,
    reward_rows, minted_ids, quiz_counts, perplexity, dataset_id,
)}
ORACLES = {
    "gsm_extract": f"WITH r AS (SELECT doc_id, text AS prediction FROM documents UNION ALL SELECT -id, prediction FROM {NUMBERS.sql}) SELECT doc_id, {_NUM.format(c='prediction')} AS number FROM r",
    "gsm_reward": f"""WITH n AS (SELECT id, prediction, {_NUM.format(c='prediction')} AS p, {_NUM.format(c='gold')} AS g FROM {_ALL_NUMBERS})
      SELECT id, coalesce(p = g, false) AS ok, CASE WHEN coalesce(p = g, false) THEN 1.0 WHEN contains(prediction, '####') AND p IS NOT NULL THEN 0.1 ELSE 0.0 END::DOUBLE AS reward FROM n""",
    "building_reward": f"WITH {_TAGGED} SELECT id, kind, reward, reward >= 0.999 AS ok FROM w",
    "accuracy_by_kind": f"WITH {_TAGGED} SELECT kind, count(*) AS n, (count(*) FILTER (reward >= 0.999))::BIGINT AS hits, round(avg((reward >= 0.999)::INT), 9) AS accuracy FROM w GROUP BY kind",
    "anchor_match": rf"""WITH r AS (SELECT conv_id * 1000 + turn + 1000 AS id, regexp_extract(text, '^(\S+ \S+)', 1) AS anchor, lower(text) AS answer FROM conversations WHERE role = 'assistant'
      UNION ALL SELECT id, anchor, answer FROM {ANCHORS.sql}) SELECT id, {_anchor_sql('anchor', 'answer')} AS found FROM r""",
    "anchor_reward": rf"""WITH r AS (SELECT conv_id, turn, text, list_concat([w FOR w IN string_split_regex(text, '[\s.,]+') IF regexp_full_match(w, '[A-Za-z]{{4,}}')][1:4], ['absent anchor']) AS anchors FROM conversations WHERE role = 'assistant'),
      s AS (SELECT conv_id, turn, text, len([a FOR a IN anchors IF {_anchor_sql('a', 'text')}]) / greatest(1, len(anchors)) AS share FROM r)
      SELECT conv_id, turn, round(CASE WHEN length(text) > 1700 THEN share * 0.9 ELSE share END, 9)::DOUBLE AS reward FROM s""",
    "grounding_gate": f"""WITH {_GATED} SELECT id, '' AS intent, len(in_slice)::BIGINT AS n_anchors,
      'system=Answer from the data.|user=' || {_PROMPT.format(c='slice', q='question')} || '|assistant=' || {_STRIP.format(c='answer')} AS chat
      FROM k WHERE {_STRIP.format(c='answer')} <> '' AND stated >= greatest(2, ceil(0.8 * len(in_slice)))""",
    "judge_scores": f"WITH {_JUDGED} SELECT id, intent, score, score_rounded, error, strict_score FROM r",
    "judge_summary": f"""WITH {_JUDGED} SELECT count(*) AS n, round(avg(score_rounded), 9) AS judge_score, count(*) FILTER (score_rounded >= 0.999) AS n_full,
      count(*) FILTER (score_rounded > 0 AND score_rounded < 0.999) AS n_partial, count(*) FILTER (score_rounded = 0) AS n_zero FROM r""",
    "judge_by_intent": "SELECT source AS intent, count(*) AS n, round(avg(quality::DOUBLE), 9) AS mean_score FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "mcq_parse": f"""SELECT id, coalesce(nullif(regexp_extract(upper(reply), '[ABCD]', 0), ''), '?') AS letter,
      q || chr(10) || chr(10) || array_to_string([substr('ABCDEFGH', i::BIGINT, 1) || '. ' || choices[i] FOR i IN range(1, len(choices) + 1)], chr(10)) || chr(10) || chr(10) || 'Answer:' AS prompt FROM {CHOICES.sql}""",
    "mcq_accuracy": f"""WITH o AS (SELECT topic, coalesce(coalesce(nullif(regexp_extract(upper(reply), '[ABCD]', 0), ''), '?') = answer, false) AS ok FROM {CHOICES.sql})
      SELECT topic, count(*) AS n, (count(*) FILTER (ok))::BIGINT AS hits, avg(ok::INT)::DOUBLE AS accuracy FROM o GROUP BY ROLLUP (topic)""",
    "mcq_validity": f"SELECT id, coalesce(len(choices) = 4 AND contains('ABCD', answer), false) AS valid, coalesce(len(choices) = 4 AND regexp_full_match(answer, '[ABCD]'), false) AS strictly_valid FROM {CHOICES.sql}",
    "majority_baseline": "WITH c AS (SELECT quality::VARCHAR AS answer, count(*) AS n FROM labels GROUP BY 1) SELECT (SELECT answer FROM c ORDER BY n DESC, answer DESC LIMIT 1) AS answer, round(max(n) / sum(n), 9)::DOUBLE AS accuracy FROM c",
    "parse_llm_object": f"SELECT id, {_JSON} AS object_text, coalesce(json_valid({_JSON}), false) AS parsed FROM {VERDICTS.sql}",
    "parse_llm_array": f"SELECT id::BIGINT AS id, n_items::BIGINT AS n_items, questions FROM {PARSED.sql}",
    "augment_docs": f"WITH {_AUGMENTED} SELECT doc_id || CASE WHEN ok THEN '-aug' ELSE '' END AS id, topic, md5(text) AS text_md5, length(body)::BIGINT AS in_chars, ok FROM a",
    "augmentation_ratio": f"WITH {_AUGMENTED} SELECT count(*) AS n, count(*) FILTER (ok) AS n_ok, sum(length(text))::BIGINT AS chars_out, round(sum(length(text)) / greatest(1, sum(length(body))), 9)::DOUBLE AS ratio FROM a",
    "sft_messages": "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS content_md5 FROM conversations GROUP BY conv_id",
    "sft_render_gold": f"SELECT item_id, md5('system:sys' || chr(10) || 'user:' || {_PROMPT.format(c=chr(39) + 'ctx' + chr(39), q='text')} || chr(10) || 'assistant:' || md5(text)) AS chat_md5 FROM benchmark",
    "reward_rows": f"WITH {_GATED} SELECT id, array_to_string(in_slice, '|') AS anchors, 2::BIGINT AS n_messages FROM k",
    "minted_ids": "SELECT doc_id, substr(source, 1, 3) || '-' || lpad(doc_id::VARCHAR, greatest(2, length(doc_id::VARCHAR))::INT, '0') AS minted, 'cq-' || lpad(doc_id::VARCHAR, greatest(3, length(doc_id::VARCHAR))::INT, '0') || '-1' AS quiz_id, md5(text || '<end>') AS ended_md5 FROM documents",
    "quiz_counts": f"SELECT topic, count(*) AS n FROM {CHOICES.sql} GROUP BY topic",
    "preference_pairs": """SELECT source AS prompt, min(md5(text)) FILTER (quality = 1) AS chosen, min(md5(text)) FILTER (quality <> 1) AS rejected FROM documents JOIN labels USING (doc_id)
      GROUP BY source HAVING chosen IS NOT NULL AND rejected IS NOT NULL""",
    "rejection_sample": f"SELECT id::BIGINT AS id, sample::BIGINT AS sample, prediction FROM {SAMPLES.sql} WHERE {_NUM.format(c='prediction')} = {_NUM.format(c='gold')}",
    "exam_rows": f"SELECT id, coalesce(persona, '') AS persona, coalesce(intent, '') AS intent, question, coalesce(answer, '') AS ground_truth, coalesce(source, '') AS source, array_to_string(anchors, '|') AS anchors FROM {ITEMS.sql}",
    "intent_counts": f"SELECT intent, count(*) AS n FROM {ITEMS.sql} GROUP BY intent",
    "backend_parts": "SELECT lower(n_name) || ':m:' || n_nationkey AS backend, lower(n_name) AS provider, 'm:' || n_nationkey AS model FROM nation",
    "perplexity": "SELECT round(exp(sum(value / 10 * (event_id % 50)) / greatest(1, sum(event_id % 50))), 6) AS perplexity, count(*) AS n_docs FROM events WHERE event_id % 50 >= 1",
    "dataset_id": """SELECT doc_id, substr(sha256('{"k":' || doc_id || ',"source":"' || source || '"}'), 1, 12) AS dataset_id FROM documents""",
}
