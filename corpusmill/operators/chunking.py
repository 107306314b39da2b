"""Retrievable chunks: paragraphs, and line windows of those that are too long.

A window's start depends on where the one before it ended, so this walk is a Python function over Arrow batches; the
same in higher-order functions took more than twice the time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET = 1600
WHOLE_UP_TO = 1.7
OVERLAP = 2


def line_windows(paragraph: str, target: int) -> Iterator[str]:
    lines = paragraph.split("\n")
    ends = [0, *accumulate(len(x) + 1 for x in lines)]
    begin = 0
    while begin < len(lines):
        end = min(max(bisect_left(ends, ends[begin] + target), begin + 1), len(lines))
        yield "\n".join(lines[begin:end])
        begin = max(end - OVERLAP, begin + 1)


def chunks_of(text: str, target: int = TARGET) -> Iterator[str]:
    for paragraph in re.split(r"\n\s*\n", text):
        if paragraph.strip():
            if len(paragraph) <= target * WHOLE_UP_TO:
                yield paragraph
            else:
                yield from line_windows(paragraph, target)


def chunk_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", target: int = TARGET) -> DataFrame:
    """The kept columns, k (from 0 within the text) and chunk."""
    names = [*keep, "k", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, place, found = [], [], []
            for r, text in enumerate(batch[text_col].to_pylist()):
                for k, c in enumerate(chunks_of(text or "", target)):
                    rows.append(r)
                    place.append(k)
                    found.append(c)
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(rows, pa.int64())) for c in keep), pa.array(place, pa.int64()), pa.array(found, pa.string())], names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*keep, F.col(text_col)).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "k long, chunk string"]))
