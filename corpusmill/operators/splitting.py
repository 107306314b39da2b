"""Deterministic splits and samples along a document order."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.staging import numbered

HELDOUT_EVERY = 20


def systematic_holdout(docs: DataFrame, *order: Column, every: int = HELDOUT_EVERY) -> DataFrame:
    """With i (place in order) and heldout: every `every`-th document, the first included."""
    return numbered(docs, *order).withColumn("heldout", F.col("i") % every == 0)


def systematic_sample(docs: DataFrame, n: int, *order: Column) -> DataFrame:
    """Every (rows div n)-th document in order, n at most, with its place j in the sample."""
    rows = numbered(docs, *order)
    step = max(1, docs.count() // max(1, n))
    return rows.where((F.col("i") % step == 0) & (F.col("i") < step * n)).withColumn("j", (F.col("i") / step).cast("long")).drop("i")


def seeded_take(tasks: DataFrame, n: int | None, *order: Column, seed: int = 3407) -> DataFrame:
    """The first n (None or 0: all) rows of the seeded shuffle of the ordered rows, with their place.

    The permutation is the standard generator's, so it is made on the driver: one number for each row of a task table.
    """
    rows = numbered(tasks, *order)
    places = list(range(tasks.count()))
    random.Random(seed).shuffle(places)
    order_of = tasks.sparkSession.createDataFrame([(p, k) for k, p in enumerate(places[: n or None])], "i long, place long")
    return rows.join(order_of, "i").drop("i")


def quiz_windows(docs: DataFrame, windows: int = 1, size: int = 1800, least: int = 400, text_col: str = "text") -> DataFrame:
    """One row for each of the first `windows` passages of `size` characters that has `least` or more when stripped."""
    from corpusmill.functions import text as T

    body = T.after_header(F.col(text_col))
    rows = docs.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    rows = rows.withColumn("passage", T.strip(F.substring(body, F.col("w") * size + 1, F.lit(size))))
    return rows.where(F.length("passage") >= least)
