"""Run telemetry: leaderboards, series and current values of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

RUN = ("exp", "run_id")
#: Metrics that a trainer's log may bring into an event.
LOGGED = ("loss", "reward", "learning_rate", "grad_norm", "kl")


def logged_metrics(metrics: Column) -> Column:
    """Of a map from metric to value: the known ones that have a value; null if none is left."""
    kept = F.map_filter(metrics, lambda k, v: k.isin(*LOGGED) & v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def run_leaderboard(meta: DataFrame) -> DataFrame:
    """Runs with their place, newest first; a missing start counts as 0."""
    order = Window.orderBy(F.coalesce("started", F.lit(0.0)).desc(), *RUN)  # one row for each run
    return meta.withColumn("place", F.row_number().over(order))


def run_summary(meta: DataFrame, now: float) -> DataFrame:
    """With delta (after less baseline, to 4 places, null without a baseline), elapsed seconds and better."""
    delta = F.when(F.col("baseline").isNotNull() & F.col("after").isNotNull(), F.bround(F.col("after") - F.col("baseline"), 4))
    elapsed = F.when(F.col("status") == "running", F.lit(now) - F.col("started")).otherwise(F.coalesce("ended", "started") - F.col("started"))
    better = F.when(T.lower_is_better(F.col("metric")), delta < 0).otherwise(delta > 0)
    return meta.withColumn("delta", delta).withColumn("elapsed", elapsed).withColumn("better", better)


def best_run(scores: DataFrame) -> DataFrame:
    """The first of the highest value in order of `run_order`: one row (run_order, value to 4 places)."""
    best = scores.agg(F.max_by(F.struct("run_order", "value"), F.struct("value", -F.col("run_order"))).alias("best"))
    return best.select("best.run_order", F.bround("best.value", 4).alias("value"))


def best_replay(scores: list[tuple[int, float]]) -> tuple[int, float] | None:
    """The pointer that updates one after another leave, each compared with the rounded value before it."""
    best: tuple[int, float] | None = None
    for order, value in sorted(scores):
        if best is None or value > best[1]:
            best = (order, round(value, 4))
    return best


def run_series(events: DataFrame) -> DataFrame:
    """(exp, run_id, metric, step, value) of the values that are there, from (…, step, metrics map)."""
    points = events.select(*RUN, "step", F.explode("metrics").alias("metric", "value"))
    return points.where(F.col("value").isNotNull() & ~F.isnan("value"))


def run_latest(series: DataFrame) -> DataFrame:
    """The value of the last step of each run and metric; of equal steps the greatest value."""
    return series.groupBy(*RUN, "metric").agg(F.max_by("value", F.struct("step", "value")).alias("value"), F.max("step").alias("step"))


def series_scaled(series: DataFrame) -> DataFrame:
    """With y from 0 to 1 between the series' least and greatest value; 0.5 where it is flat."""
    own = Window.partitionBy(*RUN, "metric")
    low, high = F.min("value").over(own), F.max("value").over(own)
    return series.withColumn("low", low).withColumn("high", high).withColumn("y", F.when(F.col("high") == F.col("low"), 0.5).otherwise(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low"))))


def latest_meta(updates: DataFrame) -> DataFrame:
    """The last of each run's meta rows by `updated`."""
    rest = [c for c in updates.columns if c not in (*RUN, "updated")]
    return updates.groupBy(*RUN).agg(F.max_by(F.struct(*rest), "updated").alias("m")).select(*RUN, "m.*")


def finished(updates: DataFrame) -> DataFrame:
    """The meta rows that end runs, from (…, baseline, after, ended): done, with delta (to 4 places) where both numbers are there."""
    delta = F.bround(F.col("after") - F.col("baseline"), 4)
    return updates.withColumn("status", F.lit("done")).withColumn("delta", delta)


def run_details(meta: DataFrame, events: DataFrame) -> DataFrame:
    """Each run's meta beside its events, joined by both keys; a run without events has one row without a step."""
    return meta.join(events, list(RUN), "left")


def run_events(events: DataFrame, exp: str, run_id: str) -> DataFrame:
    """The events of one run, by both of its keys as values; a run that isn't there has none."""
    return events.where((F.col("exp") == exp) & (F.col("run_id") == run_id))


def series_keys(events: DataFrame) -> DataFrame:
    """The metrics of each run that have a value at some step."""
    return run_series(events).select(*RUN, "metric").distinct()


def duration_text(seconds: Column) -> Column:
    """1h 2m 03s, without hours below one; a dash for null."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    hours = F.floor(s / 3600)
    text = F.concat(F.when(hours > 0, F.concat(hours, F.lit("h "))).otherwise(""), F.floor(F.pmod(s, F.lit(3600)) / 60), F.lit("m "), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"), F.lit("s"))
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")), "\u2014").otherwise(text)


def number_text(x: Column, digits: int = 3) -> Column:
    """No digits after the point from 1000 on, `digits` from 1 on, below that three significant ones; a dash for null."""
    a = F.abs(x)
    fixed = lambda n: F.regexp_replace(F.format_number(x, n), ",", "")
    small = fixed(12)
    for power in range(9, 0, -1):  # 0.1 to 1 has three places, each power of ten below it one more
        small = F.when(a >= 10.0**-power, fixed(power + 2)).otherwise(small)
    return F.when(x.isNull() | F.isnan(x), "\u2014").when(a >= 1000, fixed(0)).when(a >= 1, fixed(digits)).when(a == 0, "0").otherwise(small)
