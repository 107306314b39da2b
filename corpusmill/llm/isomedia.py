"""Media columns in ISO base media containers (MP4 family): written for any bytes, and probed without decoding payloads.

The probe walks the nested boxes, decodes the sample tables (stts, stsz, stsc, stco or co64, stss) into byte offsets,
and gives codec, duration and the byte ranges of the keyframes; sample bytes are read only where they are asked for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcore
from .common import bounded_batches, staged, text_or_empty

FRAME = 64  # bytes of a sample
RATE = 8000
KEY_EVERY = 16
CHUNK_FRAMES = 64
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
_BATCH = 8 << 20


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
_HDLR = full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0")
_SMHD = full(b"smhd", bytes(4))
_DINF = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
_STSD = full(b"stsd", struct.pack(">I", 1), box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16)))


def padded(data: bytes) -> bytes:
    """data and zero bytes, up to a positive multiple of FRAME."""
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def wrap(payload: bytes) -> bytes:
    """A container of one track of 8-bit samples in frames of FRAME bytes; every KEY_EVERY-th frame is a keyframe."""
    frames = len(payload) // FRAME
    mdat = box(b"mdat", payload)
    base = len(_FTYP) + len(mdat) - len(payload)
    chunks = -(-frames // CHUNK_FRAMES)
    tail = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] if chunks > 1 else []
    if not runs or tail != CHUNK_FRAMES:
        runs.append((chunks, tail, 1))
    keys = range(1, frames + 1, KEY_EVERY)
    wide = base + len(payload) >= 1 << 32
    at = [base + i * CHUNK_FRAMES * FRAME for i in range(chunks)]
    stbl = box(
        b"stbl", _STSD,
        full(b"stts", struct.pack(">III", 1, frames, FRAME)),
        full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, frames)),
        full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *at)),
    )
    length = frames * FRAME
    times = struct.pack(">QQIQ", 0, 0, RATE, length)
    mvhd = full(b"mvhd", times, struct.pack(">IH10x", 1 << 16, 1 << 8), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    tkhd = full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 1 << 8, 0), _MATRIX, bytes(8), version=1, flags=3)
    mdia = box(b"mdia", full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=1), _HDLR, box(b"minf", _SMHD, _DINF, stbl))
    return _FTYP + mdat + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def boxes(data: memoryview, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin of the body, end) of the boxes from lo to hi; a box that passes the end raises ValueError."""
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:  # to the end of the file
            size = hi - lo
        if size < head or lo + size > hi:
            raise ValueError(f"box {kind!r} at {lo} has the size {size}")
        yield kind, lo + head, lo + size
        lo += size


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray | None = None  # of samples, in bytes
    offsets: np.ndarray | None = None
    keys: np.ndarray | None = None  # indices of keyframes

    def payload(self, data: bytes) -> bytes:
        """Sample bytes in order; neighbouring samples are one slice."""
        ends = self.offsets + self.sizes
        cut = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        first, last = np.append(0, cut), np.append(cut - 1, len(ends) - 1)
        return b"".join(data[int(self.offsets[a]) : int(ends[b])] for a, b in zip(first, last, strict=True)) if len(ends) else b""


def _u32(data: memoryview, at: int, n: int) -> np.ndarray:
    return np.frombuffer(data, ">u4", n, at).astype(np.int64)


def _track(data: memoryview, lo: int, hi: int) -> Track:
    out, tables, todo = Track(), {}, [(lo, hi)]
    while todo:
        for kind, a, b in boxes(data, *todo.pop()):
            if kind in _PARENTS:
                todo.append((a, b))
            elif kind == b"mdhd":
                out.timescale, out.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
            elif kind == b"hdlr":
                out.handler = bytes(data[a + 8 : a + 12]).decode("latin1")
            elif kind == b"stsd" and struct.unpack_from(">I", data, a + 4)[0]:
                out.codec = bytes(data[a + 12 : a + 16]).decode("latin1").strip()
            else:
                tables[kind] = (a, b)
    if b"stsz" in tables:
        a = tables[b"stsz"][0]
        one, n = struct.unpack_from(">II", data, a + 4)
        out.sizes = np.full(n, one, np.int64) if one else _u32(data, a + 12, n)
    else:
        out.sizes = np.zeros(0, np.int64)
    n = len(out.sizes)
    if b"stco" in tables or b"co64" in tables:
        wide = b"co64" in tables
        a = tables[b"co64" if wide else b"stco"][0]
        chunks = struct.unpack_from(">I", data, a + 4)[0]
        at = np.frombuffer(data, ">u8" if wide else ">u4", chunks, a + 8).astype(np.int64)
        a = tables[b"stsc"][0]
        runs = _u32(data, a + 8, 3 * struct.unpack_from(">I", data, a + 4)[0]).reshape(-1, 3)
        each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], chunks + 1)))
        chunk = np.repeat(np.arange(chunks), each)[:n]
        before = np.append(0, np.cumsum(out.sizes))[:-1]
        first = np.append(0, np.cumsum(each))[:-1]
        out.offsets = at[chunk] + before - before[first[chunk]]
    else:
        out.offsets = np.zeros(n, np.int64)
    if b"stss" in tables:
        a = tables[b"stss"][0]
        out.keys = _u32(data, a + 8, struct.unpack_from(">I", data, a + 4)[0]) - 1
    else:  # without the table every sample is a keyframe
        out.keys = np.arange(n)
    return out


def tracks(media: bytes) -> list[Track]:
    """Of each trak box of a container."""
    data = memoryview(media)
    return [_track(data, a, b) for kind, lo, hi in boxes(data, 0, len(data)) if kind == b"moov" for kind, a, b in boxes(data, lo, hi) if kind == b"trak"]


def _wrapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = textcore.flat(batch["text"])
        for lo, hi in textcore._spans(at, _BATCH):
            media = [wrap(padded(data[a:b].tobytes())) for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(at[lo : hi + 1]), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def media_of_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, padded with zeros, in a container.

    Null and empty texts are FRAME zero bytes; equal texts give equal bytes; repeated rows stay; other columns go.
    """
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_wrapping, "doc_id long, n_bytes long, media binary")


_PROBE = "codec string, handler string, timescale long, duration long, n_samples long, keyframes array<struct<at:long,size:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tracks array<struct<codec:string,handler:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<at:long,size:long>>,payload_bytes:long,payload_sha256:string,tail_crc32:long,feature:string>>"
_OF_TRACK = ("codec", "handler", "timescale", "duration", "n_samples", "keyframes", "payload_bytes", "payload_sha256", "tail_crc32", "feature")


def _described(t: Track, media: bytes) -> dict:
    payload = t.payload(media)
    at, size = t.offsets[t.keys].tolist(), t.sizes[t.keys].tolist()
    feature = f"{t.codec}/{t.timescale}/{t.duration}/{len(t.sizes)}:" + ",".join(f"{a}+{n}" for a, n in zip(at, size, strict=True))
    keys = [{"at": a, "size": n} for a, n in zip(at, size, strict=True)]
    return dict(zip(_OF_TRACK, (t.codec, t.handler, t.timescale, t.duration, len(t.sizes), keys, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature), strict=True))


def _probing(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))
        kinds = {"codec": pa.string(), "handler": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "n_samples": pa.int64(), "keyframes": pair, "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string()}
        kinds |= {"media_bytes": pa.int64(), "media_sha256": pa.string(), "tracks": pa.list_(pa.struct(list(kinds.items())))}
        names = [*_OF_TRACK[:-1], "media_bytes", "media_sha256", "feature", "tracks"]
        for batch in batches:
            rows = []
            for media in batch["media"]:
                media = media.as_py()
                if media is None:
                    rows.append([None] * len(names))
                    continue
                each = [_described(t, media) for t in tracks(media)]
                first = each[0] if each else _described(Track(sizes=np.zeros(0, np.int64), offsets=np.zeros(0, np.int64), keys=np.zeros(0, np.int64)), media)
                whole = first | {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "tracks": each}
                rows.append([whole[c] for c in names])
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(x, kinds[c]) for x, c in zip(columns, names, strict=True))], [*keep, *names])

    return run


def probe(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The kept columns and, from the column media alone, of its first track: codec, handler, timescale, duration (in units
    of timescale), n_samples, keyframes (byte ranges in the file), digests of the samples, and feature; digests of the file;
    and tracks: the same of every track.

    Null media gives nulls; a file without a track has empty tables; damaged boxes raise ValueError.
    """
    bounded_batches(media.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in media.schema.fields}
    return media.select(*keep, "media").mapInArrow(_probing(list(keep)), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), _PROBE]))


def stored_media(docs: DataFrame) -> DataFrame:
    """media_of_texts, stored in the shared folder and read back."""
    return staged(media_of_texts(docs), "media")
