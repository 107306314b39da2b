"""Scorer packs: a task's split, its extractor and its graders, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from corpusmill.functions import text as T
from corpusmill.operators import grading

CONTRACT = ("load_split", "is_correct", "reward", "extract_answer")


@dataclass(frozen=True)
class Pack:
    """load_split takes (tasks, split, n); the graders take columns (prediction, gold)."""

    load_split: Callable[[DataFrame, str, int | None], DataFrame]
    is_correct: Callable[[Column, Column], Column]
    reward: Callable[[Column, Column], Column]
    extract_answer: Callable[[Column], Column]


_KNOWN: dict[str, object] = {}


def register(name: str, pack: object) -> None:
    missing = [f for f in CONTRACT if not callable(getattr(pack, f, None))]
    if missing:
        raise AttributeError(f"pack {name} lacks {', '.join(missing)}")
    _KNOWN[name] = pack


def load(name: str) -> object:
    if name not in _KNOWN:
        raise FileNotFoundError(f"no pack {name}")
    return _KNOWN[name]


def _rows(tasks: DataFrame, split: str, n: int | None) -> DataFrame:
    from corpusmill.sources.files import first_rows

    return first_rows(tasks.where(tasks["split"] == split), n)


def _shuffled(tasks: DataFrame, split: str, n: int | None) -> DataFrame:
    from corpusmill.operators.splitting import seeded_take

    return seeded_take(tasks.where(tasks["split"] == split), n, tasks["building"], tasks["kind"], tasks["about"])


register("numbers", Pack(_rows, grading.number_correct, grading.number_reward, T.final_number))
register("building", Pack(_shuffled, grading.tagged_correct, grading.tagged_reward, T.strip))
