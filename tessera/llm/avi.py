"""AVI files of motion JPEG: writing, reading by their index, and finding shots.

Shots are cut where the difference of neighbouring frames' grey histograms
stands out from the differences around it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import ACROSS, FRAME_BYTES, Frame, encode_bytes

#: Microseconds a frame in files written here.
FRAME_US = 40_000
#: Grey levels of a histogram; frames on each side that a difference is held against.
LEVELS, AROUND = 16, 8


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, extra: bytes = b"") -> bytes:
    """A RIFF file of JPEG frames with an index; ``extra`` is kept in the stream's data chunk."""
    n = len(frames)
    main = struct.pack("<14I", FRAME_US, 0, 0, 0x10, n, 0, 1, max(map(len, frames), default=0), width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, FRAME_US, 1_000_000, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form) + (_chunk(b"strd", extra) if extra else b""))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + strl)
    movie, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movie.append(c)
        at += len(c)
    body = b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Video:
    frame_us: int
    frames: list[bytes]
    extra: bytes


def read_avi(data: bytes) -> Video:
    """Frames of the first video stream, by the index if there is one, else in the order of the file.

    Offsets in an index count from the movie list or from the file's start;
    both are met, and told apart by where the first chunk's name is.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    frame_us, extra, movi, index, stream, streams = FRAME_US, b"", None, b"", None, 0

    def walk(at: int, end: int) -> None:
        nonlocal frame_us, extra, movi, index, stream, streams
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, min(body + size, end))
                else:
                    walk(body + 4, min(body + size, end))
            elif name == b"avih":
                frame_us = struct.unpack_from("<I", data, body)[0] or FRAME_US
            elif name == b"strh":
                if stream is None and data[body : body + 4] == b"vids":
                    stream = streams
                streams += 1
            elif name == b"strd":
                extra = data[body : body + size]
            elif name == b"idx1":
                index = data[body : body + size]
            at = body + size + (size & 1)

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movi is None:
        raise ValueError("no movie list")
    names = {b"%02ddc" % (stream or 0), b"%02ddb" % (stream or 0)}
    frames = []
    entries = [struct.unpack_from("<4sIII", index, i) for i in range(0, len(index) - 15, 16)]
    entries = [e for e in entries if e[0] in names]
    if entries:
        base = movi[0] if data[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
        frames = [data[base + o + 8 : base + o + 8 + n] for _, _, o, n in entries]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":  # a record of chunks
                at += 12
                continue
            if name in names:
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return Video(frame_us, [f for f in frames if f], extra)


def histograms(frames: Iterator[Frame]) -> np.ndarray:
    """Shares of grey levels, a row a frame, as counts in 1/65536."""
    rows = []
    for f in frames:
        p = f.luma()
        rows.append(np.bincount((p >> 4).ravel(), minlength=LEVELS) * 65536 // max(1, p.size))
    return np.array(rows, np.int64).reshape(-1, LEVELS)


def shot_starts(h: np.ndarray, factor: float = 3.0, floor: int = 6554) -> list[int]:
    """First frames of the shots.

    A cut is where the histograms' difference is the largest of its
    neighbourhood, over ``floor`` (a tenth of all pixels), and over the
    neighbourhood's mean by ``factor`` mean absolute deviations.
    """
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) // 2
    starts = [0] if len(h) else []
    for i in range(len(d)):
        near = np.concatenate([d[max(0, i - AROUND) : i], d[i + 1 : i + 1 + AROUND]])
        if d[i] <= floor or (len(near) and d[i] <= near.max()):
            continue
        mean = near.mean() if len(near) else 0.0
        if d[i] > mean + factor * (np.abs(near - mean).mean() if len(near) else 0.0):
            starts.append(i + 1)
    return starts


def store(payload: bytes) -> bytes:
    """An AVI file that holds ``payload``, whose length is in its stream data."""
    return write_avi(encode_bytes(payload), 8 * ACROSS, 8 * ACROSS, struct.pack("<Q", len(payload)))


def stored(video: Video) -> tuple[bytes, list[Frame]]:
    """The payload and the decoded frames of a file made by ``store``."""
    frames = [Frame(f) for f in video.frames]
    return b"".join(f.held() for f in frames)[: struct.unpack("<Q", video.extra)[0]], frames


def clips(df: DataFrame, media: str = "media", factor: float = 3.0) -> DataFrame:
    """Rows of the shots in a column of AVI files: ``df``'s other columns, and the clip's.

    Added: clip (from 0), first_frame, frames, start_ms, end_ms, level (mean
    grey level), error.  A null file gives no row; one that can't be read gives
    one row with clip null and the reason in error; a file without frames gives
    none.  Columns of ``df`` with these names are replaced.
    """
    new = ["clip", "first_frame", "frames", "start_ms", "end_ms", "level", "error"]

    @F.udf(useArrow=True, returnType="array<struct<clip:int,first_frame:long,frames:long,start_ms:double,end_ms:double,level:double,error:string>>")
    def cut(data):
        if data is None:
            return []
        try:
            video = read_avi(bytes(data))
            h = histograms(Frame(f) for f in video.frames)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return [(None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
        starts, ms = shot_starts(h, factor), video.frame_us / 1000
        out = []
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(h)])):
            level = float((h[a:b] * np.arange(LEVELS)).sum() / max(1, h[a:b].sum()))
            out.append((k, a, b - a, a * ms, b * ms, level, None))
        return out

    rows = df.withColumn("_clips", F.explode(cut(F.col(media))))
    rest = [c for c in df.columns if c != media and c.lower() not in new]
    return rows.select(*rest, *[F.col(f"_clips.{c}").alias(c) for c in new])


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text stored as an AVI file and read back: doc_id and the columns of ``MEDIA``.

    The payload is the text's UTF-8 bytes (null: none) and zeros up to a
    positive multiple of 64, a byte a coefficient.  Everything but n_bytes is
    computed from what is read back.  feature: frames, shots, the shots' first
    frames and the mean histogram.  Equal texts give equal values; a narrow
    step, a document at a time.
    """

    def row(t: str | None) -> tuple:
        raw = (t or "").encode("utf-8", "surrogatepass")
        media = store(raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0))
        payload, frames = stored(read_avi(media))
        h = histograms(iter(frames))
        starts = shot_starts(h)
        feature = (
            f"frames={len(frames)};shots={len(starts)};starts={','.join(map(str, starts))};"
            f"histogram={','.join(map(str, h.sum(axis=0) // max(1, len(h))))}"
        )
        return (
            len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
            len(media), hashlib.sha256(media).hexdigest(), feature,
        )

    @F.pandas_udf(MEDIA)
    def through(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in MEDIA.split(",")]
        for t in batches:
            yield pd.DataFrame([row(x) for x in t], columns=names)

    return df.select(df[doc_id].alias(doc_id), through(df[text]).alias("_m")).select(doc_id, "_m.*")


__all__ = ["FRAME_BYTES", "clips", "read_avi", "shot_starts", "store", "stored", "text_media", "write_avi"]
