"""Gates on generated rows: grounded demonstrations, rejection sampling, replies parsed and augmented documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import grading, retrieval, splitting
from corpusmill.operators.staging import numbered

MIN_ANCHORS = 2
GATE_SHARE = 0.8


def enough_in_slice(in_slice: Column, least: int = MIN_ANCHORS) -> Column:
    """The gate before generation: cheap, so it stands before the generating column."""
    return F.size(in_slice) >= least


def grounded(in_slice: Column, answer: Column, least: int = MIN_ANCHORS, share: float = GATE_SHARE) -> Column:
    """The gate after it: the answer isn't blank and states most anchors of the slice."""
    wanted = F.greatest(F.lit(least), F.ceil(F.lit(share) * F.size(in_slice)))
    return F.coalesce(T.strip(answer) != "", F.lit(False)) & (F.size(T.anchors_in(in_slice, answer)) >= wanted)


def with_in_slice(rows: DataFrame) -> DataFrame:
    """The rows whose slice states enough of their anchors, and these as in_slice.

    As a generator's column it is computed once: a filter on a plain column is pushed below it and computes it again.
    """
    return rows.select("*", F.explode(F.array(T.anchors_in(F.col("anchors"), F.col("slice")))).alias("in_slice")).where(enough_in_slice(F.col("in_slice")))


def grounding_gate(rows: DataFrame, system_prompt: str, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """From (id, intent, persona, source, question, anchors, slice[, answer]): the kept demonstrations as messages.

    generate maps the prompt to the answer's column; without it the rows bring their answers.
    """
    kept = with_in_slice(rows).withColumn("prompt", T.grounded_prompt(F.col("slice"), F.col("question")))
    if generate:
        kept = kept.withColumn("answer", generate(F.col("prompt")))
    kept = kept.where(grounded(F.col("in_slice"), F.col("answer")))
    chat = T.messages(system=F.lit(system_prompt), user=F.col("prompt"), assistant=T.strip(F.col("answer")))
    return kept.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("intent", "persona", "source")), chat.alias("messages"), F.size("in_slice").cast("long").alias("n_anchors"))


def reward_rows(rows: DataFrame, system_prompt: str) -> DataFrame:
    """(id, messages, anchors) for reward training: questions with anchors, enough of which their slice states."""
    kept = with_in_slice(rows)
    chat = T.messages(system=F.lit(system_prompt), user=T.grounded_prompt(F.col("slice"), F.col("question")))
    return kept.select("id", chat.alias("messages"), F.col("in_slice").alias("anchors"))


def quiz_counts(quiz: DataFrame) -> DataFrame:
    return quiz.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def with_terminator(text: Column, mark: str) -> Column:
    """A training document and the mark that ends it."""
    return F.concat(text, F.lit(mark))


def rejection_sample(samples: DataFrame, prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """Samples that the number grader calls right."""
    return samples.where(grading.number_correct(F.col(prediction), F.col(gold)))


_ITEM = "array<struct<id:string,persona:string,intent:string,question:string,answer:string,anchors:array<string>,source:string>>"


def reply_candidates(reply: Column) -> tuple[Column, Column]:
    """A reply's array as it stands, and cut after its last object and closed."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(T.strip(reply), r"(?m)^```(?:json)?|```$", "")), r"^\s+|\s+\z", "")
    body = F.regexp_extract(bare, r"(?s)\[.*", 0)
    whole = F.regexp_extract(body, r"(?s)^.*\]", 0)
    cut = F.concat(F.regexp_extract(body, r"(?s)^.*\}", 0), F.lit("]"))
    return F.nullif(whole, F.lit("")), F.when(body.contains("}"), cut)


def well_formed_items(candidate: Column) -> Column:
    """Items with question, answer and anchors; elements that aren't such objects go one by one. Null if it isn't JSON."""
    elements = F.variant_get(F.try_parse_json(candidate), "$", "array<variant>")
    texts = F.transform(elements, lambda e: F.from_json(F.to_json(e), _ITEM.removeprefix("array<").removesuffix(">")))
    return F.filter(texts, lambda x: (F.coalesce(x["question"], F.lit("")) != "") & (F.coalesce(x["answer"], F.lit("")) != "") & (F.coalesce(F.size(x["anchors"]), F.lit(0)) > 0))


def parse_items(reply: Column) -> Column:
    """The well-formed items of the first candidate that has any."""
    first, second = (well_formed_items(c) for c in reply_candidates(reply))
    none = F.expr(f"CAST(array() AS {_ITEM})")
    return F.when(F.coalesce(F.size(first), F.lit(0)) > 0, first).otherwise(F.coalesce(second, none))


def minted_id(corpus: Column, place: Column) -> Column:
    """The corpus's first three characters and the item's place, of two digits or more."""
    return F.format_string("%s-%02d", F.substring(corpus, 1, 3), place)


def quiz_id(document: Column, window: Column) -> Column:
    return F.format_string("cq-%03d-%d", document, window)


def augmented(docs: DataFrame, reply_col: str = "reply") -> DataFrame:
    """(id, topic, text, in_chars, ok): the whole body, then paraphrases and questions of the reply; without a readable reply the body alone."""
    shape = "struct<paraphrases:array<string>,qa:array<struct<q:string,a:string>>>"
    body = T.strip(T.after_header(F.col("text")))
    read = docs.select("id", "topic", body.alias("body"), F.from_json(T.json_object_text(F.col(reply_col)), shape).alias("v"))
    none = F.expr("CAST(array() AS array<string>)")
    phrases = F.coalesce(F.filter("v.paraphrases", lambda p: F.coalesce(T.strip(p), F.lit("")) != ""), none)
    pairs = F.filter("v.qa", lambda x: (F.coalesce(x["q"], F.lit("")) != "") & (F.coalesce(x["a"], F.lit("")) != ""))
    asked = F.coalesce(F.transform(pairs, lambda x: F.concat(F.lit("Q: "), x["q"], F.lit("\nA: "), x["a"])), none)
    text = F.array_join(F.concat(F.array("body"), phrases, asked), "\n\n")
    ok = F.col("v").isNotNull()
    return read.select(F.when(ok, F.concat("id", F.lit("-aug"))).otherwise(F.col("id")).alias("id"), "topic", F.when(ok, text).otherwise(F.col("body")).alias("text"), F.length("body").cast("long").alias("in_chars"), ok.alias("ok"))


def exam_rows(items: DataFrame) -> DataFrame:
    """Authored items as frozen exam rows: answer becomes ground_truth, missing texts are empty."""
    texts = [F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in (("id", "id"), ("persona", "persona"), ("intent", "intent"), ("question", "question"), ("answer", "ground_truth"), ("source", "source"))]
    return items.select(*texts, F.coalesce("anchors", F.expr("CAST(array() AS array<string>)")).alias("anchors"))


def intent_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def generator(client: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """A text-generating column: client answers a batch of prompts; it is made on the executors once for each partition."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(client(prompts.tolist()), dtype="object")

    return generate


def dispatched(backend: str, clients: dict[str, Callable[[str, list[str]], list[str]]]) -> Callable[[list[str]], list[str]]:
    """The client of a backend `provider:model`: clients maps a provider to a function of the model and prompts. ValueError for an unknown one."""
    provider, _, model = backend.partition(":")
    if provider not in clients:
        raise ValueError(f"unknown backend provider: {provider!r} (known: {', '.join(sorted(clients))})")
    return lambda prompts: clients[provider](model, prompts)


def authored(cached: DataFrame, fresh: DataFrame, again: bool = False) -> DataFrame:
    """Items by building: the cached ones where a building has any (unless `again`), else the fresh ones."""
    if again:
        return fresh
    return cached.unionByName(fresh.join(cached.select("building").distinct(), "building", "left_anti"))


def grounded_training(items: DataFrame, chunks: DataFrame, heads: DataFrame, system_prompt: str, generate: Callable[[Column], Column], budget: int = retrieval.BUDGET) -> DataFrame:
    """Authored items (building, id, intent, persona, source, question, anchors) to demonstrations: the slice of its
    building that each question needs, the gates and the generated answer. Ids are unique."""
    asked = items.select(F.col("id").alias("question_id"), F.col("building").alias("corpus_id"), "question")
    slices = retrieval.retrieve(asked, chunks, heads, budget).select(F.col("question_id").alias("id"), "slice")
    found = grounding_gate(items.join(slices, "id"), system_prompt, generate)
    return found.join(items.select("id", "building"), "id")


def gate_counts(items: DataFrame, kept: DataFrame) -> DataFrame:
    """(building, authored, kept, dropped)."""
    every = items.groupBy("building").agg(F.count(F.lit(1)).alias("authored"))
    left = kept.groupBy("building").agg(F.count(F.lit(1)).alias("kept"))
    both = every.join(left, "building", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return both.withColumn("dropped", F.col("authored") - F.col("kept"))


_QUIZ = "q string, choices array<string>, answer string"


def corpus_quiz(docs: DataFrame, generate: Callable[[Column], Column], n: int = 40, windows: int = 1, strict: bool = False) -> DataFrame:
    """(id, topic, q, choices, answer, src): questions on passages of a sample of (id, topic, text); replies without four choices and a letter go."""
    picked = splitting.quiz_windows(splitting.systematic_sample(docs, n, F.col("id")), windows)
    asked = picked.withColumn("reply", generate(F.concat(F.lit("PASSAGE:\n"), F.col("passage"))))
    read = asked.withColumn("v", F.from_json(T.json_object_text(F.col("reply")), _QUIZ))
    valid = read.where(F.col("v").isNotNull() & grading.choices_valid(F.col("v.choices"), F.col("v.answer"), strict))
    return valid.select(quiz_id(F.col("j"), F.col("w")).alias("id"), "topic", "v.q", "v.choices", "v.answer", F.col("id").alias("src"))


def augment(docs: DataFrame, generate: Callable[[Column], Column], n: int | None = None) -> DataFrame:
    """`augmented` of the first n of (id, topic, text) by id (None or 0: all), with the generator's replies to their bodies."""
    rows = numbered(docs, F.col("id")).where(F.col("i") < n).drop("i") if n else docs
    return augmented(rows.withColumn("reply", generate(T.strip(T.after_header(F.col("text"))))))


def echo_client(prompts: list[str]) -> list[str]:
    """A deterministic stand-in: the prompt's last 200 characters before its question, as JSON-free text."""
    return [p.rsplit("--- END BUILDING DATA ---", 1)[0][-200:].strip() for p in prompts]


def backend_parts(backend: Column) -> tuple[Column, Column]:
    """Provider (before the first colon) and model (all after it)."""
    provider = F.substring_index(backend, ":", 1)
    return provider, F.substring(backend, F.length(provider) + 2, F.length(backend))


def preference_pairs(rows: DataFrame, prompt: str, text: str, good: str) -> DataFrame:
    """(prompt, chosen, rejected): for each prompt its least good and least other text, where it has both."""
    both = rows.groupBy(prompt).agg(F.min(F.when(F.col(good), F.col(text))).alias("chosen"), F.min(F.when(~F.col(good), F.col(text))).alias("rejected"))
    return both.where("chosen IS NOT NULL AND rejected IS NOT NULL").select(F.col(prompt).alias("prompt"), "chosen", "rejected")


def compact_json(spec: dict) -> str:
    return json.dumps(spec, sort_keys=True, separators=(",", ":"))
