"""Queries of telemetry, artifacts and the event stream. Events stand for a trainer's log: a run for each user, a metric for each event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import artifacts, telemetry
from corpusmill.operators.staging import shared_path
from corpusmill.plans.inline import Inline, table
from corpusmill.streaming import runs as stream

RUNS = Inline("exp string, run_id string, metric string, baseline double, after double, status string, started double, ended double", (
    ("a", "r1", "eval_acc", 0.36, 0.54, "done", 100.0, 700.0), ("a", "r2", "eval_ppl", 12.5, 9.25, "done", 200.0, 260.0), ("b", "r1", "train_loss", 1.0, 1.25, "done", 150.0, None),
    ("b", "r2", "eval_acc", None, 0.5, "done", 300.0, 310.0), ("c", "r1", "eval_acc", 0.5, None, "running", 400.0, None), ("c", "r2", "eval_acc", 0.25, 0.25, "done", None, 9.0),
))
SCORES = Inline("run_order long, value double", ((1, 0.51234), (2, 0.51231), (3, 0.75), (4, 0.75), (5, 0.1)))
#: After every event id.
LATER = 1_000_000_000_000.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = F.create_map(F.col("event_type"), F.when(F.col("event_id") % 11 != 0, F.col("value")))
    return table(spark, sf_dir, "events").select(F.lit("e").alias("exp"), F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("step"), F.unix_timestamp("ts").cast("double").alias("t"), metrics.alias("metrics"))


def run_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.min("event_id").cast("double").alias("started"), F.max("value").alias("after"))
    return telemetry.run_leaderboard(meta.withColumn("exp", F.lit("e"))).withColumn("place", F.col("place").cast("long"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user: its first event's value is the baseline, its last one's the result; every tenth still runs. Event ids are seconds."""
    user, seen = F.col("user_id"), F.when(F.col("value").isNotNull(), F.col("event_id"))
    meta = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", seen).alias("baseline"), F.max_by("value", seen).alias("after"), F.min("event_id").cast("double").alias("started"), F.max("event_id").cast("double").alias("ended"))
    named = meta.select(F.lit("e").alias("exp"), user.cast("string").alias("run_id"), F.when(user % 2 == 0, "eval_acc").otherwise("train_loss").alias("metric"), "baseline", "after", F.when(user % 10 == 0, "running").otherwise("done").alias("status"), "started", "ended")
    return telemetry.run_summary(named.unionByName(RUNS.frame(spark)), LATER).select("exp", "run_id", "delta", "elapsed", "better")


def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user, whose score is its greatest value."""
    scores = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_order")).agg(F.max("value").alias("value"))
    return telemetry.best_run(scores.unionByName(SCORES.frame(spark).withColumn("run_order", -F.col("run_order"))))


def run_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.run_series(_events(spark, sf_dir))


def run_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.run_latest(telemetry.run_series(_events(spark, sf_dir)))


def run_series_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.series_scaled(telemetry.run_series(_events(spark, sf_dir)))
    return found.select("run_id", "metric", "step", F.round("y", 9).alias("y"))


def logged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks come as a loss, views as a reward, other events under names that aren't logged."""
    name = F.when(F.col("event_type") == "click", "loss").when(F.col("event_type") == "view", "reward").otherwise("other")
    rows = table(spark, sf_dir, "events").select("event_id", telemetry.logged_metrics(F.create_map(name, F.when(F.col("event_id") % 11 != 0, F.col("value")))).alias("m"))
    return rows.where("m IS NOT NULL").select("event_id", F.explode("m").alias("metric", "value"))


def one_runs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.run_series(telemetry.run_events(_events(spark, sf_dir), "e", "7"))


def series_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.series_keys(_events(spark, sf_dir))


def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7.5).alias("seconds"))
    return rows.select("event_id", telemetry.duration_text(F.col("seconds")).alias("duration"))


def artifact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as an artifact, found again by the pointer, and read."""
    root = shared_path(spark, "artifacts")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    artifacts.cached(spark, root, {"source": "documents", "columns": 3}, lambda: rows)
    path = artifacts.latest(spark, root)
    made = artifacts.provenance(spark, path)
    return artifacts.read(spark, path, "doc_id long, lang string, n_chars long").withColumn("n_rows", F.lit(made["n"]).cast("long"))


def stream_run_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended as three batches of files, then read as a stream until no file is new."""
    root, events = shared_path(spark, "stream"), _events(spark, sf_dir)
    for k in range(3):
        stream.append_events(events.where(F.col("step") % 3 == k), f"{root}/events")
    found = stream.latest_stream(stream.event_stream(spark, f"{root}/events", files_per_batch=4))
    return stream.run_available(found, f"{root}/latest", f"{root}/checkpoint")


_ALL_RUNS = f"""(SELECT 'e' AS exp, user_id::VARCHAR AS run_id, CASE WHEN user_id % 2 = 0 THEN 'eval_acc' ELSE 'train_loss' END AS metric, arg_min(value, event_id) AS baseline, arg_max(value, event_id) AS after,
      CASE WHEN user_id % 10 = 0 THEN 'running' ELSE 'done' END AS status, min(event_id)::DOUBLE AS started, max(event_id)::DOUBLE AS ended FROM events GROUP BY user_id
      UNION ALL SELECT exp, run_id, metric, baseline, after, status, started, ended FROM {RUNS.sql})"""
_ALL_SCORES = f"(SELECT user_id AS run_order, max(value) AS value FROM events GROUP BY user_id UNION ALL SELECT -run_order, value FROM {SCORES.sql})"
_SERIES = "s AS (SELECT 'e' AS exp, user_id::VARCHAR AS run_id, event_type AS metric, event_id AS step, value FROM events WHERE event_id % 11 <> 0)"
_LATEST = f"WITH {_SERIES} SELECT exp, run_id, metric, arg_max(value, step) AS value, max(step) AS step FROM s GROUP BY exp, run_id, metric"
QUERIES = {f.__name__: f for f in (run_leaderboard, run_summary, best_run, run_series, run_latest, run_series_scaled, logged_metrics, one_runs_events, series_keys, duration_text, artifact_roundtrip, stream_run_latest)}
ORACLES = {
    "run_leaderboard": """WITH m AS (SELECT user_id::VARCHAR AS run_id, min(event_id)::DOUBLE AS started, max(value) AS after, 'e' AS exp FROM events GROUP BY user_id)
      SELECT *, row_number() OVER (ORDER BY coalesce(started, 0) DESC, exp, run_id) AS place FROM m""",
    "run_summary": f"""WITH d AS (SELECT *, CASE WHEN baseline IS NOT NULL AND after IS NOT NULL THEN round_even(after - baseline, 4)::DOUBLE END AS delta FROM {_ALL_RUNS})
      SELECT exp, run_id, delta, CASE WHEN status = 'running' THEN {LATER:.1f} - started ELSE coalesce(ended, started) - started END::DOUBLE AS elapsed,
             CASE WHEN regexp_matches(metric, '(?i)ppl|perplex|loss') THEN delta < 0 ELSE delta > 0 END AS better FROM d""",
    "best_run": f"SELECT run_order::BIGINT AS run_order, round_even(value, 4)::DOUBLE AS value FROM {_ALL_SCORES} ORDER BY value DESC, run_order LIMIT 1",
    "run_series": f"WITH {_SERIES} SELECT * FROM s",
    "run_latest": _LATEST,
    "run_series_scaled": f"""WITH {_SERIES}, w AS (SELECT *, min(value) OVER p AS lo, max(value) OVER p AS hi FROM s WINDOW p AS (PARTITION BY run_id, metric))
      SELECT run_id, metric, step, round(CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END, 9)::DOUBLE AS y FROM w""",
    "logged_metrics": """SELECT event_id, CASE event_type WHEN 'click' THEN 'loss' ELSE 'reward' END AS metric, value FROM events WHERE event_type IN ('click', 'view') AND event_id % 11 <> 0""",
    "one_runs_events": f"WITH {_SERIES} SELECT * FROM s WHERE run_id = '7'",
    "series_keys": f"WITH {_SERIES} SELECT DISTINCT exp, run_id, metric FROM s",
    "duration_text": """WITH s AS (SELECT event_id, floor(event_id * 7.5)::BIGINT AS s FROM events)
      SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' ELSE '' END || ((s % 3600) // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' AS duration FROM s""",
    "artifact_roundtrip": "SELECT doc_id, lang, n_chars, (SELECT count(*) FROM documents) AS n_rows FROM documents",
    "stream_run_latest": _LATEST,
}
