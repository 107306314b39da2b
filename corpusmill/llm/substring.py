"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, and the repeated ones merged.

Documents are dealt into blocks by a hash. Windows that can't repeat are told first: a window's anchor is the least hash of
the runs of `anchor_words` words in it, so that equal windows have equal anchors, and a window whose anchor stands nowhere
else is the only one of its words. Spark counts the anchors (a tenth of the windows), then the window hashes of those
whose anchors repeat, and both ways what repeats goes back to its blocks. A block sends a hash once, or twice if it has it
more than once: a frequent passage is a row or two for each block, however hot, and rows are never more than windows.
A block at last covers the words of repeated windows and merges them into maximal intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore
from .common import bounded_batches, text_or_empty, utf8_total

RESULT = "doc_id long, n_words long, n_removed long, intervals array<struct<start:int,stop:int>>, kept_text string"
_ROWS = "hash long, block long"


def _least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width = 1
    while width < n:
        step = min(width, n - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


class Block:
    """Words of a block's texts, and of each window in one text its place, hash and anchor."""

    def __init__(self, texts: pa.Array, k: int, m: int):
        self.words = textcore.words(texts)
        h = textcore.word_hashes(self.words)
        windows, self.runs = textcore.window_hashes(h, k), textcore.window_hashes(h, m)
        self.place = np.flatnonzero(textcore.in_one_text(self.words.doc_at, k, len(windows)))
        self.hash = windows[self.place]
        self.anchor = _least_of(self.runs, k - m + 1)[self.place] if len(windows) else windows

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, and which of them stand in two places or more."""
        found = np.unique(self.anchor)
        if not len(found):
            return found, np.zeros(0, bool)
        at = np.minimum(np.searchsorted(found, self.runs), len(found) - 1)
        return found, np.bincount(at[found[at] == self.runs], minlength=len(found)) > 1


def _rows(distinct: np.ndarray, twice: np.ndarray, table: pa.Table) -> pa.Table:
    rows = np.concatenate([distinct, distinct[twice]]).view(np.int64)
    block = table["block"][0].as_py() if len(table) else 0
    return pa.table({"hash": pa.array(rows), "block": pa.array(np.full(len(rows), block, np.int64))})


def _anchoring(k: int, m: int):
    def run(table: pa.Table) -> pa.Table:
        return _rows(*Block(table["text"], k, m).anchors(), table)

    return run


def _is_in(values: np.ndarray, some: pa.ChunkedArray) -> np.ndarray:
    wanted = np.unique(some.to_numpy().view(np.uint64))
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values if len(wanted) else np.zeros(len(values), bool)


def _hashing(k: int, m: int):
    def run(table: pa.Table, anchors: pa.Table) -> pa.Table:
        block = Block(table["text"], k, m)
        distinct, count = np.unique(block.hash[_is_in(block.anchor, anchors["hash"])], return_counts=True)
        return _rows(distinct, count > 1, table)

    return run


def repeated(rows: DataFrame) -> DataFrame:
    """(block, hash) of the hashes that have two rows or more. Spark's window over a hash spills."""
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("hash")))
    return counted.where("n > 1").select("block", "hash")


def covered(place: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """Which words the windows that begin at these places cover."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + k, -1)
    return np.cumsum(change[:-1]) > 0


def _remover(k: int, m: int):
    def remove(table: pa.Table, hashes: pa.Table) -> pa.Table:
        block = Block(table["text"], k, m)
        w, n = block.words, len(block.words.start)
        gone = covered(block.place[_is_in(block.hash, hashes["hash"])], k, n)
        change = np.diff(gone.astype(np.int8), prepend=0)
        begin = change == 1
        first = w.doc_at[:-1][w.counts > 0]
        begin[first] = gone[first]
        end = np.zeros(n, bool)
        end[:-1] = gone[:-1] & (~gone[1:] | begin[1:])
        end[-1:] = gone[-1:]
        lo, hi = np.flatnonzero(begin), np.flatnonzero(end) + 1
        owner = np.searchsorted(w.doc_at, lo, "right") - 1
        span_at = np.searchsorted(lo, w.doc_at).astype(np.int32)
        pair = pa.StructArray.from_arrays([pa.array((x - w.doc_at[owner]).astype(np.int32)) for x in (lo, hi)], ["start", "stop"])
        # Kept words and one space after each, but the last of a text.
        kept = ~gone
        size = (w.stop - w.start) + 1
        total = np.append(0, np.cumsum(kept))
        kept_at = total[w.doc_at]
        sizes = size[kept]
        last = kept_at[1:][np.diff(kept_at) > 0] - 1
        sizes[last] -= 1
        out_at = np.append(0, np.cumsum(sizes))
        source = np.repeat(w.start[kept] - out_at[:-1], sizes) + np.arange(out_at[-1])
        text = np.append(w.data, np.uint8(32))[source]
        space = out_at[1:] - 1
        space = np.delete(space, last)
        text[space] = 32
        gone_at = np.append(0, np.cumsum(gone))[w.doc_at]
        texts = pa.StringArray.from_buffers(len(table), pa.py_buffer(out_at[kept_at].astype(np.int32)), pa.py_buffer(text))
        return pa.table({
            "doc_id": table["doc_id"].cast(pa.int64()), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(np.diff(gone_at), pa.int64()),
            "intervals": pa.ListArray.from_arrays(pa.array(span_at), pair), "kept_text": texts,
        })

    return remove


def in_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """doc_id, text and block, of which each has about block_bytes of text.

    By the row's hash and its partition's number: equal rows of one partition share a block, so that repeated rows, however
    many, are groups no larger than a partition of the input.
    """
    blocks = max(1, -(-utf8_total(docs) // block_bytes))
    key = F.xxhash64("doc_id", "text", F.spark_partition_id())
    return docs.select("doc_id", text_or_empty().alias("text")).withColumn("block", F.pmod(key, F.lit(blocks)))


def candidate_rows(blocks: DataFrame, k: int, m: int) -> DataFrame:
    """(hash, block) of the windows whose anchors repeat: one row for each distinct one, two for one that the block has more than once."""
    anchors = repeated(blocks.groupBy("block").applyInArrow(_anchoring(k, m), _ROWS))
    return blocks.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(_hashing(k, m), _ROWS)


def dedup_substrings(docs: DataFrame, k: int = 35, block_bytes: int = 6 << 20, anchor_words: int | None = None) -> DataFrame:
    """Removes each word that a window of k words covers whose words also begin anywhere else in the table.

    Result: doc_id, n_words, n_removed, intervals (maximal, in words of the text) and kept_text (one space between words).
    Null and empty texts have no words and keep an empty text; a text of under k words has no window; repeated rows
    repeat each other's windows, so that both lose them; a null doc_id stays null; other columns are left out.

    block_bytes bounds what one Python group reads of texts (a longer text fills its block). All three readings of the
    blocks share one exchange. anchor_words (half of k) changes the rows sent, never the result. Hashes have 64 bits: n
    windows give about n*n/2**65 wrong pairs, 0.0003 for 10**8.
    """
    bounded_batches(docs.sparkSession)
    m = anchor_words or (k + 1) // 2
    blocks = in_blocks(docs, block_bytes)
    hashes = repeated(candidate_rows(blocks, k, m))
    return blocks.groupBy("block").cogroup(hashes.groupBy("block")).applyInArrow(_remover(k, m), RESULT)
