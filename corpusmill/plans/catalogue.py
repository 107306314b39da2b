"""The engine's queries by name, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import cleaning, grading, graph, runs, training

_PARTS = (cleaning, grading, graph, runs, training)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: sql for part in _PARTS for k, sql in part.ORACLES.items()}
