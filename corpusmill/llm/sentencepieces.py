"""SentencePiece encoding and decoding by weighted finite-state transducers over the tropical semiring.

Three machines are compiled from a model file: the normaliser (the file's character map as longest-match rewriting, its
rules for spaces, a mark before the text and for each space), the pieces (a trie whose final states write a piece), and
the byte fallback (a character that no piece spells writes its bytes). A text goes through the first; each segment of what
comes out is composed with the union of the other two as far as the search asks, and its ids are those of the shortest path.

Weights: a unigram model's arc weighs the piece's negative score. A merge model (BPE) has no additive score, so there the
composed machine's states remember the last piece, and the arc to the next weighs 0 if merging the two pieces' characters
gives just these two, and infinity otherwise. Merging is local, so exactly one path has a finite weight: the merges'
result. One search serves both: states come out by weight, then the furthest first.

The pieces never cross the place before a mark that follows another character, nor a line break that no piece spells;
texts are cut there, and each distinct segment is solved once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .common import bounded_batches, text_or_empty

MARK = "▁"
_INF = float("inf")
_BATCH = 2 << 20


def read_model(path: str):
    """The model file's message; ValueError for a model with other rules than the machines here have.

    Those are: marks for spaces, bytes for unknown characters, and no pieces of the user's own.
    """
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    model = ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal, trained, piece = model.normalizer_spec, model.trainer_spec, ModelProto.SentencePiece
    unigram = trained.model_type == trained.UNIGRAM
    bad = {
        "rules of its own for decoding": bool(model.denormalizer_spec.precompiled_charsmap),
        "spaces without a mark": not normal.escape_whitespaces,
        "marks after words": trained.treat_whitespace_as_suffix,
        "no bytes for unknown characters": not trained.byte_fallback or sum(x.type == piece.BYTE for x in model.pieces) != 256,
        "user-defined or unused pieces": any(x.type in (piece.USER_DEFINED, piece.UNUSED) for x in model.pieces),
        "neither merges nor additive scores": trained.model_type not in (trained.BPE, trained.UNIGRAM),
        "scores above 0": unigram and any(x.type == piece.NORMAL and x.score > 0 for x in model.pieces),
    }
    if any(bad.values()):
        raise ValueError(f"{path}: not built for a model with {', '.join(k for k, v in bad.items() if v)}")
    return model


def _charsmap(data: bytes) -> dict[bytes, bytes]:
    """What a precompiled character map rewrites: a double array of 32-bit units, then texts that end in a zero byte."""
    if not data:
        return {}
    size = struct.unpack_from("<I", data)[0]
    units, texts = np.frombuffer(data, "<u4", size // 4, 4).tolist(), data[4 + size :]

    def children(at: int) -> int:
        return at ^ (units[at] >> 10 << ((units[at] & 0x200) >> 6))

    found, todo = {}, [(0, b"")]
    while todo:
        at, key = todo.pop()
        base = children(at)
        if units[at] & 0x100 and key:
            start = units[base] & 0x7FFFFFFF
            found[key] = texts[start : texts.index(b"\0", start)]
        for c in range(1, 256):
            if base ^ c < len(units) and units[base ^ c] & 0x800000FF == c:
                todo.append((base ^ c, key + bytes([c])))
    return found


class Normaliser:
    """A deterministic transducer over bytes: the longest rule that fits is written, else a character as it is.

    Spaces stand for marks until a segment is solved. `squeeze`: runs of spaces are one, and none begins or ends a text.
    """

    def __init__(self, rules: dict[bytes, bytes], prefix: bool, squeeze: bool):
        self.prefix, self.squeeze = prefix, squeeze
        self.trie: list[dict[int, int]] = [{}]
        self.write: list[bytes | None] = [None]
        for key, text in rules.items():
            state = 0
            for c in key:
                if c not in self.trie[state]:
                    self.trie[state][c] = len(self.trie)
                    self.trie.append({})
                    self.write.append(None)
                state = self.trie[state][c]
            self.write[state] = text

    def _step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What is written for the input from `at` on, and where the rest begins."""
        state, out, stop = 0, None, at
        for i in range(at, len(data)):
            state = self.trie[state].get(data[i], -1)
            if state < 0:
                break
            if self.write[state] is not None:
                out, stop = self.write[state], i + 1
        if out is None:
            stop = at + (1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4)
            out = data[at:stop]
        return out, stop

    def one(self, data: bytes) -> bytes:
        out, at, space = [], 0, self.squeeze
        while at < len(data):
            text, at = self._step(data, at)
            while space and text.startswith(b" "):
                text = text[1:]
            if text:
                out.append(text)
                space = self.squeeze and text.endswith(b" ")
        text = b"".join(out)
        if self.squeeze:
            while text.endswith((b" ", MARK.encode())):
                text = text[:-1] if text.endswith(b" ") else text[: -len(MARK.encode())]
            if not text:
                return b""
        return b" " + text if self.prefix and data else text

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the normalised texts; without rules only the mark before a text is new."""
        if len(self.trie) == 1 and not self.squeeze:
            full = (np.diff(at) > 0) & self.prefix
            return np.insert(data, at[:-1][full], 32), np.append(0, np.cumsum(np.diff(at) + full))
        texts = [self.one(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))


def shortest_path(arcs: Callable[[int], list], end: int, weight: Callable[[int], float] | None, follows: Callable[[int | None, int], bool] | None) -> list[int]:
    """The outputs along the lightest path from place 0 to `end`; arcs gives (place, output) of the arcs at a place.

    An arc weighs weight(output), which is never below 0 (None: 0); with `follows` states remember the last output, and an
    arc weighs infinity if it may not follow that. As this is dear, it is asked when an arc's turn comes. Of equal paths
    that with the longer last output is taken.
    """
    came: dict = {}
    heap: list = [(0.0, 0, 0, None, None)]
    while heap:
        total, place, _, out, before = heappop(heap)
        state = (place, out) if follows else place
        if state in came or follows and before and not follows(before[1], out):
            continue
        came[state] = before, out
        if -place == end:
            path = []
            while before is not None:
                path.append(out)
                before, out = came[before]
            return path[::-1]
        for stop, piece in arcs(-place):
            heappush(heap, (total + weight(piece) if weight else 0.0, -stop, -place, piece, state))
    raise ValueError("no path")


class Machine:
    """The composed transducer of one model."""

    _loaded: dict[tuple[str, str | None], "Machine"] = {}

    def __init__(self, pieces: list[tuple[str, float, str]], kind: str, normaliser: Normaliser | None = None):
        """pieces: (text, score, type: normal, byte, or anything else for pieces that no text spells), by id."""
        self.kind, self.normaliser = kind, normaliser or Normaliser({}, True, False)
        self.trie: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        self.score: dict[str, float] = {}
        self.byte = np.zeros(256, np.uint32)
        self.spell: list[bytes] = []
        for i, (text, score, what) in enumerate(pieces):
            self.spell.append(text.replace(MARK, " ").encode() if what == "normal" else b"")
            if what == "normal":
                self.score[text] = score
                state = 0
                for c in text:
                    if c not in self.trie[state]:
                        self.trie[state][c] = len(self.trie)
                        self.trie.append({})
                        self.final.append(-1)
                    state = self.trie[state][c]
                self.final[state] = i
            elif what == "byte":
                value = int(text[3:5], 16)
                self.byte[value], self.spell[-1] = i, bytes([value])
        self.lowest = min(self.score.values(), default=0.0) - 10
        self.inside = any(MARK in t.lstrip(MARK) for t in self.score)  # then a text can't be cut at its marks
        self.line = any("\n" in t for t in self.score)
        self.text = [t for t, _, _ in pieces]
        self.together: dict[tuple[int, int], bool] = {}
        self.memo = textcore.Memo(400_000)
        self.spelled = np.frombuffer(b"".join(self.spell), np.uint8)
        self.spelled_at = np.append(0, np.cumsum([len(x) for x in self.spell]))

    @classmethod
    def of(cls, path: str, kind: str | None = None) -> "Machine":
        """From a model file, which also says its kind; ValueError if that isn't the one asked for."""
        if (path, kind) not in cls._loaded:
            model = read_model(path)
            found = "unigram" if model.trainer_spec.model_type == model.trainer_spec.UNIGRAM else "bpe"
            if kind not in (None, found):
                raise ValueError(f"{path}: a {found} model, not {kind}")
            normal, types = model.normalizer_spec, {1: "normal", 6: "byte"}
            normaliser = Normaliser(_charsmap(normal.precompiled_charsmap), normal.add_dummy_prefix, normal.remove_extra_whitespaces)
            cls._loaded[path, kind] = cls([(x.piece, x.score, types.get(x.type, "other")) for x in model.pieces], found, normaliser)
        return cls._loaded[path, kind]

    def merged(self, text: str) -> list[str]:
        """What a merge model makes of a text: the pair of the highest score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -_INF) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -_INF:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """(end, id) of the pieces that begin here, the longest last; without one of a single character, first that
        character's fallback, whose id is -1 less its code point."""
        arcs, trie, final, state = [], self.trie, self.final, 0
        for stop in range(at, len(text)):
            state = trie[state].get(text[stop], -1)
            if state < 0:
                break
            if final[state] >= 0:
                arcs.append((stop + 1, final[state]))
        if not arcs or arcs[0][0] > at + 1:
            arcs.insert(0, (at + 1, -1 - ord(text[at])))
        return arcs

    def _spelled(self, piece: int) -> str:
        return self.text[piece] if piece >= 0 else chr(-1 - piece)

    def _follows(self, before: int | None, piece: int) -> bool:
        """Whether the arc of a merge model from one piece to another weighs 0 (None: from the start)."""
        found = self.together.get((before, piece))
        if found is None:
            if len(self.together) > 500_000:
                self.together.clear()
            parts = [self._spelled(piece)] if before is None else [self._spelled(before), self._spelled(piece)]
            found = self.together[before, piece] = self.merged("".join(parts)) == parts
        return found

    def shortest(self, text: str) -> list[int]:
        """Ids along the shortest path for a normalised segment that isn't empty."""
        if self.kind == "unigram":
            path = shortest_path(lambda at: self._arcs(text, at), len(text), lambda p: -self.score[self.text[p]] if p >= 0 else -self.lowest, None)
        else:
            path = shortest_path(lambda at: self._arcs(text, at), len(text), None, self._follows)
        if min(path) >= 0:
            return path
        return [i for p in path for i in ([p] if p >= 0 else self.byte[list(chr(-1 - p).encode())].tolist())]

    def _solve(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.shortest(s.as_py().decode().replace(" ", MARK)) for s in segments]
        return np.array([i for x in found for i in x], np.uint32), np.append(0, np.cumsum([len(x) for x in found]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and len+1 offsets; an empty text has none."""
        data, at = textcore.flat(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data, at = self.normaliser(data, at)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        full = np.diff(at) > 0
        cut = np.zeros(len(data), bool)
        if not self.inside:
            mark = (data == 0x81) & (np.roll(data, 1) == 0x96) & (np.roll(data, 2) == 0xE2)
            cut[1:] = (data[1:] == 32) & (data[:-1] != 32) & ~mark[:-1]
        if not self.line:
            cut |= data == 10
            cut[1:] |= data[:-1] == 10
        cut[at[:-1][full]] = True
        segment_at = np.append(np.flatnonzero(cut), len(data))
        segments = textcore.cut(data, segment_at)
        ids, ids_at = self.memo(segments.dictionary, self._solve)
        out, out_at = textcore.ragged_take(ids, ids_at, segments.indices.to_numpy())
        return out, out_at[np.searchsorted(segment_at, at)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and offsets: what the pieces spell, without the mark that the normaliser puts before a text."""
        data, data_at = textcore.ragged_take(self.spelled, self.spelled_at, ids)
        text_at = data_at[at]
        if not (self.normaliser.prefix or self.normaliser.squeeze):
            return data, text_at
        full = np.flatnonzero(np.diff(text_at))
        drop = text_at[full][data[text_at[full]] == 32]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        return data[keep], np.append(0, np.cumsum(keep))[text_at]


def _encoding(path: str, kind: str | None, keep: list[str], check: bool):
    names = [*keep, "ids", *(["exact"] if check else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.of(path, kind)
        for batch in batches:
            for lo, hi in textcore._spans(textcore.flat(batch["text"])[1], _BATCH):
                part = batch.slice(lo, hi - lo)
                ids, at = machine.encode(part["text"])
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = [*(part[c] for c in keep), column]
                if check:
                    data, text_at = machine.decode(ids.astype(np.int64), at)
                    wanted, wanted_at = textcore.flat(part["text"])
                    columns.append(pa.array([bytes(data[a:b]) == bytes(wanted[c:d]) for a, b, c, d in zip(text_at[:-1], text_at[1:], wanted_at[:-1], wanted_at[1:], strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model_path: str, kind: str | None = None, keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """The kept columns, and ids: array<int>; with check, also whether the ids decode to the text (`exact`).

    Null and empty texts have no ids; repeated rows stay; other columns go. A text with the mark's own character is
    encoded as the library does it, and decodes to a space there; what a model's normaliser changes stays changed.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    bounded_batches(docs.sparkSession)
    texts = docs.select(*keep, text_or_empty().alias("text"))
    return texts.mapInArrow(_encoding(model_path, kind, list(keep), check), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>", *(["exact boolean"] if check else [])]))


def _decoding(path: str, kind: str | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.of(path, kind)
        for batch in batches:
            column = batch["ids"]
            at = column.offsets.to_numpy().astype(np.int64)
            for lo, hi in textcore._spans(at - at[0], 2 << 20):
                ids = column.values.to_numpy()[at[lo] : at[hi]].astype(np.int64)
                data, text_at = machine.decode(ids, at[lo : hi + 1] - at[lo])
                # Ids that no text gave may spell invalid UTF-8: that is replaced.
                texts = pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(text_at[:-1], text_at[1:], strict=True)], pa.string())
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (a - int(at[lo])) : 4 * (b - int(at[lo]))]) for a, b in zip(at[lo:hi].tolist(), at[lo + 1 : hi + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(lo, hi - lo) for c in keep), texts, pa.array(np.diff(at[lo : hi + 1]), pa.int64()), pa.array(crc, pa.int64())], [*keep, "text", "n_pieces", "ids_crc32"])

    return run


def decode(encoded: DataFrame, model_path: str, kind: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """From (keep, ids): the kept columns, text, n_pieces and ids_crc32 (of little-endian 32-bit ids). Null ids spell an empty text."""
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}
    bounded_batches(encoded.sparkSession)
    ids = F.coalesce(F.col("ids"), F.expr("CAST(array() AS array<int>)"))
    return encoded.select(*(c for c in keep if c != "ids"), ids.alias("ids")).mapInArrow(_decoding(model_path, kind, list(keep)), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string, n_pieces long, ids_crc32 long"]))
