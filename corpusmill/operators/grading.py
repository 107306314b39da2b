"""Graders as columns: numbers, classes, connections, anchors, judge verdicts and multiple choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

FULL = 0.999
VERDICT = "struct<matched:array<string>,missed:array<string>,contradiction:boolean>"


def number_correct(prediction: Column, gold: Column) -> Column:
    """Final numbers are equal as text, so that 5.0 isn't 5; no number is never right."""
    return F.coalesce(T.final_number(prediction) == T.final_number(gold), F.lit(False))


def number_reward(prediction: Column, gold: Column) -> Column:
    """1.0 if right, 0.1 for a well-formed final answer, else 0.0."""
    well_formed = prediction.contains("####") & T.final_number(prediction).isNotNull()
    return F.when(number_correct(prediction, gold), 1.0).when(well_formed, 0.1).otherwise(0.0)


def tagged_kind(gold: Column) -> Column:
    return F.substring_index(gold, ":", 1)


def tagged_reward(prediction: Column, gold: Column) -> Column:
    """count: the last integer equals; type: any class is named; conns: the share of connections named."""
    kind = tagged_kind(gold)
    body = F.when(gold.contains(":"), F.expr("null").cast("string")).otherwise("")
    body = F.coalesce(body, F.substring(gold, F.length(kind) + 2, F.length(gold)))
    said = F.concat(F.lit(" "), T.plain_norm(prediction), F.lit(" "))
    expected = F.transform(F.filter(F.split(body, r"\|", -1), lambda x: T.strip(x) != ""), T.plain_norm)
    hits = F.size(F.filter(expected, lambda x: F.contains(said, F.concat(F.lit(" "), x, F.lit(" ")))))
    count = F.when(F.coalesce(T.last_match(prediction, r"(?U)-?\d+") == body, F.lit(False)), 1.0).otherwise(0.0)
    return (
        F.when(kind == "count", count)
        .when(F.size(expected) == 0, 0.0)
        .when(kind == "type", F.when(hits >= 1, 1.0).otherwise(0.0))
        .otherwise(hits / F.greatest(F.size(expected), F.lit(1)))
    )


def tagged_correct(prediction: Column, gold: Column) -> Column:
    return tagged_reward(prediction, gold) >= FULL


def anchor_reward(anchors: Column, completion: Column, long_after: int = 1700, damp: float = 0.9) -> Column:
    """The share of anchors that a completion states; a long one counts less."""
    share = F.size(T.anchors_in(anchors, completion)) / F.greatest(F.lit(1), F.size(anchors))
    return F.when(F.length(completion) > long_after, share * damp).otherwise(share)


def verdict(reply: Column) -> Column:
    """The judge's JSON inside its reply, or null."""
    return F.from_json(T.json_object_text(reply), VERDICT)


def judge_score(found: Column, anchors: Column, strict: bool = False) -> Column:
    """Matched anchors over all; a contradiction leaves at most a half; no verdict scores 0.

    A match that is listed twice counts twice unless strict, so that the score may exceed 1.
    """
    matched = F.coalesce(found["matched"], F.expr("CAST(array() AS array<string>)"))
    known = F.filter(F.array_distinct(matched) if strict else matched, lambda x: F.array_contains(anchors, x))
    share = F.size(known) / F.greatest(F.lit(1), F.size(anchors))
    capped = F.when(F.coalesce(found["contradiction"], F.lit(False)), F.least(share, F.lit(0.5))).otherwise(share)
    return F.when(found.isNull(), 0.0).otherwise(capped)


def judged(answers: DataFrame, exam: DataFrame, strict: bool = False) -> DataFrame:
    """(id, intent, score, score_rounded, error) for answers (id, intent, reply) to exam questions (id, anchors).

    An answer without its exam question raises when the result is read.
    """
    both = answers.join(exam.select(F.col("id").alias("exam_id"), F.col("anchors").alias("exam_anchors")), F.col("id") == F.col("exam_id"), "left")
    anchors = F.when(F.col("exam_id").isNull(), F.raise_error(F.concat(F.lit("no exam question "), F.col("id")))).otherwise(F.col("exam_anchors"))
    scored = both.select("id", F.coalesce("intent", F.lit("")).alias("intent"), verdict(F.col("reply")).alias("verdict"), anchors.alias("anchors"))
    score = judge_score(F.col("verdict"), F.col("anchors"), strict)
    return scored.select("id", "intent", score.alias("score"), F.bround(score, 3).alias("score_rounded"), F.col("verdict").isNull().alias("error"))


def choice_letter(reply: Column) -> Column:
    """The first of A-D in the upper-cased reply, or ?; "The answer is B" gives A."""
    found = F.regexp_extract(F.upper(reply), "[ABCD]", 0)
    return F.when(found == "", "?").otherwise(found)


def choices_valid(choices: Column, answer: Column, strict: bool = False) -> Column:
    """Four choices and an answer among the letters; unless strict, any run of the letters passes, the empty one too."""
    letter = answer.rlike(r"^[ABCD]\z") if strict else F.contains(F.lit("ABCD"), answer)
    return F.coalesce((F.size(choices) == 4) & letter, F.lit(False))
