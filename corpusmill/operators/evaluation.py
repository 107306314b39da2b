"""Aggregates of graded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import grading


def accuracy(rows: DataFrame, ok: str = "ok", *by: str) -> DataFrame:
    """n, hits and accuracy, of all rows or by groups; of no rows the accuracy is null."""
    hits = F.coalesce(F.sum(F.col(ok).cast("long")), F.lit(0))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"), F.avg(F.col(ok).cast("double")).alias("accuracy"))


def with_total(rows: DataFrame, ok: str, by: str) -> DataFrame:
    """accuracy by a group, and a row for all, whose group is null."""
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(ok).cast("long")).alias("hits"), F.avg(F.col(ok).cast("double")).alias("accuracy"))


def majority_baseline(quiz: DataFrame) -> DataFrame:
    """What always giving the most frequent answer scores: one row."""
    counts = quiz.groupBy("answer").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("answer", F.struct("n", "answer")).alias("answer"), (F.max("n") / F.sum("n")).alias("accuracy"))


def judge_summary(scores: DataFrame) -> DataFrame:
    """One row: n, the mean of rounded scores, and how many are full, partial and zero."""
    s = F.col("score_rounded")
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("judge_score"), F.count_if(s >= grading.FULL).alias("n_full"), F.count_if((s > 0) & (s < grading.FULL)).alias("n_partial"), F.count_if(s == 0).alias("n_zero")
    )


def judge_by_intent(scores: DataFrame) -> DataFrame:
    """The mean of unrounded scores by intent."""
    return scores.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


def perplexity(losses: DataFrame, loss: str = "loss", tokens: str = "n_tokens") -> DataFrame:
    """exp of the token-weighted mean loss: (loss, n_tokens) of documents; those of under two ids (no target) are left out."""
    rows = losses.where(F.col(tokens) >= 1)
    return rows.agg(F.exp(F.coalesce(F.sum(F.col(loss) * F.col(tokens)), F.lit(0.0)) / F.greatest(F.lit(1), F.coalesce(F.sum(tokens), F.lit(0)))).alias("perplexity"), F.count(F.lit(1)).alias("n_docs"))


def corpus_provenance(docs: DataFrame) -> DataFrame:
    """One row of counts from (heldout, thin, chars); thin documents belong to no split."""
    train, held = ~F.col("thin") & ~F.col("heldout"), ~F.col("thin") & F.col("heldout")
    chars = F.coalesce(F.sum(F.when(train, F.col("chars"))), F.lit(0))
    return docs.agg(F.count_if(train).alias("n_train"), F.count_if(held).alias("n_heldout"), F.count_if("thin").alias("n_dropped_thin"), chars.alias("train_chars"), F.floor(chars / 4).cast("long").alias("train_tokens_est"))


def augmentation_ratio(rows: DataFrame) -> DataFrame:
    """One row: characters out over characters in."""
    out = F.sum(F.length("text").cast("long"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), out.alias("chars_out"), (out / F.greatest(F.lit(1), F.sum("in_chars"))).alias("ratio"))
