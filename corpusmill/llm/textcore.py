"""Words of whole batches of texts as arrays: numpy over the UTF-8 bytes, no Python object for a word.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; as those are ASCII, it is a run of whole characters.
Hashes are polynomials modulo 2**64 over random values, so that equal sequences get equal hashes in every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_BASE = int(mix(np.array([77], np.uint64))[0]) & ~7 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and len+1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = at.astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def ragged_take(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `which` of the ragged array (values, offsets), as another."""
    size = np.diff(at)[which]
    out_at = np.append(0, np.cumsum(size))
    return values[np.repeat(at[:-1][which] - out_at[:-1], size) + np.arange(out_at[-1])], out_at


class Memo:
    """Ids of distinct byte strings; a worker keeps those of the first `most`, and computes others when they come."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.known = most, pa.array([], pa.large_binary())
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, pieces: pa.Array, compute) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct pieces; compute gives both for those that aren't known."""
        seen = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(seen))
        ids, at = compute(new) if len(new) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        place = seen.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        ids, at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + at[1:]])
        if len(self.known) < self.most:
            self.known, self.ids, self.at = pa.concat_arrays([self.known, new]), ids, at
        return ragged_take(ids, at, place)


def cut(data: np.ndarray, at: np.ndarray) -> pa.DictionaryArray:
    """The byte strings between these offsets, as codes of the distinct ones."""
    if len(data) >= 1 << 31:
        raise ValueError("a batch of texts of 2 GB or more")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # their offsets
    start: np.ndarray  # first byte of each word
    stop: np.ndarray  # byte after each word
    doc_at: np.ndarray  # first word of each text, and at last the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc_at)


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, at = flat(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    solid = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edge = at[(at > 0) & (at < n)]
    begins = solid[1:-1] & ~solid[:-2]
    begins[edge] = solid[edge + 1]
    ends = solid[1:-1] & ~solid[2:]
    ends[edge - 1] = solid[edge]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, at, start, stop, np.searchsorted(start, at))


def _spans(sizes_at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cuts items with these offsets into runs of at most `most` units, or of one item."""
    out, i, n = [], 0, len(sizes_at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(sizes_at, sizes_at[i] + most, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def word_hashes(w: Words) -> np.ndarray:
    out = np.empty(len(w.start), np.uint64)
    size = w.stop - w.start
    at = np.concatenate([[0], np.cumsum(size)])
    power = powers(_BASE, int(size.max(initial=1)) + 1)
    for i, j in _spans(at, _CHUNK):
        n = int(at[j] - at[i])
        begin = at[i:j] - at[i]
        place = np.arange(n) - np.repeat(begin, size[i:j])
        value = _BYTE[w.data[place + np.repeat(w.start[i:j], size[i:j])]] * power[place]
        out[i:j] = np.add.reduceat(value, begin)
    return mix(out ^ size.astype(np.uint64) * _STEP)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp: of each k consecutive values, whichever text they are in; len(h)-k+1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, size = np.empty(n, np.uint64), min(_CHUNK, n)
    up, down = powers(_BASE, size + k), powers(_INVERSE, size + k)
    for i in range(0, n, size):
        m = min(size, n - i)
        total = np.zeros(m + k, np.uint64)
        np.cumsum(h[i : i + m + k - 1] * down[: m + k - 1], out=total[1:])
        out[i : i + m] = (total[k : k + m] - total[:m]) * up[:m]
    return mix(out)


def in_one_text(doc_at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n windows of k words lie in one text."""
    ok = np.zeros(n + 1, np.int32)
    size = np.diff(doc_at)
    long = size >= k
    np.add.at(ok, doc_at[:-1][long], 1)
    np.add.at(ok, doc_at[1:][long] - k + 1, -1)
    return np.cumsum(ok[:-1]) > 0
