"""Token ids as binary: static range asymmetric numeral coding (rANS) with one frequency table for the whole table.

First the texts are tokenized in order of doc_id and staged; their ids are counted over all documents into the shared
table; then each range of documents is coded into independent blocks of whole documents. A block interleaves LANES
coder states (token t belongs to lane t mod LANES), keeps all states at every CHECKPOINT steps, so that a reader can
begin there, and carries checksums of the ids and of its own bytes.

File format: Parquet with one row for each block, in folders part=<range> that ascend with doc_id, and `payload`:
  4 bytes magic, then little-endian u32: lanes, tokens, checkpoints, words; u64[lanes] states at the start;
  for each checkpoint u32 word offset and u64[lanes] states; u32[words] the stream. table/ has (token, freq).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textcore
from .common import bounded_batches, staged, staged_path, text_or_empty

MAGIC = b"rAN1"
SCALE = 20  # frequencies sum to 2**SCALE
LANES = 1024
CHECKPOINT = 256  # steps of LANES tokens
BLOCK_TOKENS = 1 << 20
_LOW, _U32, _SHIFT = np.uint64(1 << 31), np.uint64(32), np.uint64(SCALE)


class Tokenizer:
    """Token ids of texts; the library encodes each distinct piece once.

    The byte-level pattern always begins a new piece where white space follows a character that is not white space, and
    where a comma or full stop follows a letter, so a text is cut there.
    """

    _loaded: dict[str, "Tokenizer"] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.encode_special_tokens = True
        n = self.library.get_vocab_size()
        # In this vocabulary each character of a token's text stands for one byte.
        self.width = np.array([len(self.library.id_to_token(i) or "") for i in range(n)], np.int64)
        self.memo = textcore.Memo()

    @classmethod
    def of(cls, path: str) -> "Tokenizer":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and len+1 offsets."""
        data, at = textcore.flat(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        space = textcore._SPACE[data]
        before, lead = np.empty_like(data), np.empty_like(data)
        before[0], before[1:] = 32, data[:-1]
        lead[:2], lead[2:] = 32, data[:-2]
        # After ASCII, or a character of two bytes but those that begin with C2, where two white spaces are.
        cut = space & ((before > 32) & (before < 127) | (before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead < 0xE0))
        letter = (before | 32 >= 97) & (before | 32 <= 122) | (lead == 0xC3) & (before != 0x97) & (before != 0xB7)
        cut |= letter & ((data == 44) | (data == 46))
        cut[at[:-1][at[:-1] < n]] = True
        piece_at = np.append(np.flatnonzero(cut), n)
        pieces = textcore.cut(data, piece_at)
        ids, ids_at = self.memo(pieces.dictionary, self._new)
        out, out_at = textcore.ragged_take(ids, ids_at, pieces.indices.to_numpy())
        return out, out_at[np.searchsorted(piece_at, at)]

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = textcore.flat(pieces)
        spaced = textcore._SPACE[data[at[:-1]]]
        safe = np.flatnonzero(spaced)
        bare = np.flatnonzero(~spaced)
        size = np.zeros(len(at) - 1, np.int64)
        found: list[np.ndarray] = []
        # Pieces that begin with white space come apart again in a joined text; others are encoded one by one.
        for lo, hi in textcore._spans(np.append(0, np.cumsum(np.diff(at)[safe])), 1 << 18):
            part = safe[lo:hi]
            bytes_at = np.append(0, np.cumsum(np.diff(at)[part]))
            text = data[np.repeat(at[part] - bytes_at[:-1], np.diff(at)[part]) + np.arange(bytes_at[-1])].tobytes().decode()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(0, np.cumsum(self.width[ids]))
            ids_at = np.searchsorted(ends, bytes_at)
            if not np.array_equal(ends[ids_at], bytes_at):
                raise ValueError("a token crosses two pieces")
            size[part] = np.diff(ids_at)
            found.append(ids)
        alone = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([data[at[i] : at[i + 1]].tobytes().decode() for i in bare], add_special_tokens=False)] if len(bare) else []
        size[bare] = [len(x) for x in alone]
        flat = np.concatenate([*found, *alone, np.zeros(0, np.uint32)])
        order = np.concatenate([safe, bare])
        return textcore.ragged_take(flat, np.append(0, np.cumsum(size[order])), np.argsort(order, kind="stable"))


def normalized(counts: np.ndarray) -> np.ndarray:
    """Frequencies with the sum 2**SCALE, at least 1 for each token that occurs."""
    total, whole = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.maximum((counts.astype(np.float64) * whole / total).astype(np.int64), counts > 0)
    over = int(freq.sum()) - whole
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    i = 0
    while over > 0:  # take from the largest, never all of one
        step = min(over, int(freq[order[i]] // 2))
        freq[order[i]] -= step
        over -= step
        i = (i + 1) % len(order)
    return freq


class Coder:
    """Codes and decodes blocks by one table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        lanes, n = LANES, len(ids)
        steps = -(-n // lanes)
        state = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
        marks: dict[int, np.ndarray] = {}
        freq, low = self.freq[ids], self.low[ids]
        most = freq << np.uint64(63 - SCALE)
        for s in range(steps - 1, -1, -1):
            lo, hi = s * lanes, min(n, s * lanes + lanes)
            x, f = state[: hi - lo], freq[lo:hi]
            full = x >= most[lo:hi]
            words[s] = x[full].astype(np.uint32)
            x = np.where(full, x >> _U32, x)
            q = x // f
            state[: hi - lo] = (q << _SHIFT) + (x - q * f) + low[lo:hi]
            if s and s % CHECKPOINT == 0:
                marks[s] = state.copy()
        at = np.append(0, np.cumsum([len(x) for x in words]))
        parts = [MAGIC, struct.pack("<4I", lanes, n, len(marks), int(at[-1])), state.tobytes()]
        for s in sorted(marks):
            parts += [struct.pack("<I", int(at[s])), marks[s].tobytes()]
        return b"".join([*parts, *(x.tobytes() for x in words)])

    def decode(self, payload: bytes, checkpoint: int = 0, steps: int | None = None) -> np.ndarray:
        """Ids from a checkpoint on (0: the start), to the end or for so many steps."""
        if payload[:4] != MAGIC:
            raise ValueError("not a block")
        lanes, n, marks, size = struct.unpack_from("<4I", payload, 4)
        head = 20 + 8 * lanes
        first = head + marks * (4 + 8 * lanes)
        words = np.frombuffer(payload, np.uint32, size, first)
        at, from_ = 0, 20
        if checkpoint:
            from_ = head + (checkpoint - 1) * (4 + 8 * lanes)
            at = struct.unpack_from("<I", payload, from_)[0]
            from_ += 4
        state = np.frombuffer(payload, np.uint64, lanes, from_).copy()
        begin = checkpoint * CHECKPOINT
        end = -(-n // lanes) if steps is None else min(-(-n // lanes), begin + steps)
        out = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.uint32)
        mask = np.uint64((1 << SCALE) - 1)
        for s in range(begin, end):
            m = min(n, s * lanes + lanes) - s * lanes
            x = state[:m]
            slot = x & mask
            token = self.symbol[slot]
            x = self.freq[token] * (x >> _SHIFT) + slot - self.low[token]
            short = np.flatnonzero(x < _LOW)
            x[short] = (x[short] << _U32) | words[at : at + len(short)]
            at += len(short)
            state[:m] = x
            out[(s - begin) * lanes : (s - begin) * lanes + m] = token
        return out


def _tokenizing(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.of(path)
        wide = np.uint16 if len(tokenizer.width) <= 1 << 16 else np.uint32
        for batch in batches:
            for lo, hi in textcore._spans(textcore.flat(batch["text"])[1], 8 << 20):
                part = batch.slice(lo, hi - lo)
                ids, at = tokenizer.encode(part["text"])
                size = np.diff(at)
                with_end = np.insert(ids, at[1:], end).astype(wide)
                ends = (np.append(0, np.cumsum(size + 1)) * wide().itemsize).astype(np.int64)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(with_end)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["_mid"], pa.array(size + 1, pa.int64()), data], ["doc_id", "_mid", "n_tokens", "ids"])

    return run


def _counting(wide: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            new = np.bincount(textcore.flat(batch["ids"])[0].view(wide))
            if len(new) > len(total):
                total, new = new, total
            total[: len(new)] += new
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(total[token], pa.int64())], ["token", "n"])

    return run


def _blocking(freq: np.ndarray, wide: str):
    names = ["part", "first_mid", "doc_ids", "sizes", "n_tokens", "ids_crc32", "payload_crc32", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        count, part = 0, -1

        def block() -> pa.RecordBatch:
            ids = np.concatenate([x[2] for x in held]).astype(np.uint32)
            payload = coder.encode(ids)
            docs, size = pa.concat_arrays([x[0]["doc_id"] for x in held]), np.concatenate([x[1] for x in held])
            row = [[part], [held[0][0]["_mid"][0].as_py()], [docs.to_pylist()], [size.tolist()], [len(ids)], [zlib.crc32(ids)], [zlib.crc32(payload)], [payload]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            ids, at = textcore.flat(batch["ids"])
            ids, at = ids.view(wide), at // np.dtype(wide).itemsize
            parts = batch["_mid"].to_numpy() >> 33
            i, n = 0, len(batch)
            run_end = np.append(np.flatnonzero(np.diff(parts)) + 1, n)  # a task may read several files, in any order
            while i < n:
                if held and (parts[i] != part or count >= BLOCK_TOKENS):
                    yield block()
                    held, count = [], 0
                part = int(parts[i])
                j = min(int(run_end[np.searchsorted(run_end, i, "right")]), max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_TOKENS - count))))
                held.append((batch.slice(i, j - i), np.diff(at[i : j + 1]), ids[at[i] : at[j]]))
                count += int(at[j] - at[i])
                i = j
        if held:
            yield block()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end: int = 2, path: str | None = None) -> str:
    """Writes the ids of every text, `end` after each, in ascending doc_id (null last, ties by the text's hash).

    Null and empty texts are the end id alone; repeated rows are documents of their own; other columns are left out.
    Returns the folder. Only the table (one row for each token of the vocabulary) comes to the driver.
    """
    spark = docs.sparkSession
    path = path or staged_path(spark, "tokens")
    bounded_batches(spark)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    ranged = texts.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    rows = staged(ranged.withColumn("_mid", F.monotonically_increasing_id()).mapInArrow(_tokenizing(tokenizer_path, end), "doc_id long, _mid long, n_tokens long, ids binary"), "token-ids")
    wide = "<u2" if len(Tokenizer.of(tokenizer_path).width) <= 1 << 16 else "<u4"
    counted = rows.select("ids").mapInArrow(_counting(wide), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([end, *(r["token"] for r in counted)]) + 1, np.int64)
    for r in counted:
        counts[r["token"]] = r["n"]
    freq = normalized(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "token long, freq long").coalesce(1).write.parquet(f"{path}/table")
    blocks = rows.select("doc_id", "_mid", "ids").mapInArrow(_blocking(freq, wide), "part long, first_mid long, doc_ids array<long>, sizes array<long>, n_tokens long, ids_crc32 long, payload_crc32 long, payload binary")
    blocks.write.partitionBy("part").option("compression", "none").parquet(f"{path}/blocks")
    return path


def _reading(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for row in range(len(batch)):
                payload = batch["payload"][row].as_py()
                if zlib.crc32(payload) != batch["payload_crc32"][row].as_py():
                    raise ValueError("a block's bytes are damaged")
                ids = coder.decode(payload)
                if zlib.crc32(ids) != batch["ids_crc32"][row].as_py():
                    raise ValueError("a block's ids are damaged")
                docs, size = batch["doc_ids"][row].values, batch["sizes"][row].values.to_numpy()
                at = np.append(0, np.cumsum(size))
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.full(len(docs), batch["first_mid"][row].as_py())), pa.array(at[:-1], pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "first_mid", "before", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens, ids_crc32 of each document; damaged blocks raise."""
    freq = np.array([r["freq"] for r in spark.read.parquet(f"{path}/table").orderBy("token").collect()], np.int64)
    schema = "first_mid long, doc_ids array<long>, sizes array<long>, n_tokens long, ids_crc32 long, payload_crc32 long, payload binary, part long"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    docs = blocks.select("first_mid", "doc_ids", "sizes", "ids_crc32", "payload_crc32", "payload").mapInArrow(_reading(freq), "doc_id long, first_mid long, before long, n_tokens long, ids_crc32 long")
    # Block starts: within each range, then over the ranges, of which there are as many as files.
    inside = Window.partitionBy("part").orderBy("first_mid").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = blocks.select("part", "first_mid", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("ahead")).join(ranges.select("part", "base"), "part").select("first_mid", (F.col("ahead") + F.col("base")).alias("at"))
    return docs.join(starts, "first_mid").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
