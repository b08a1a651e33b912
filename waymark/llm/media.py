"""Operator 5: media columns as ISO base media containers.

encode() stores a payload of 8-bit samples in a container column; describe() walks nested boxes of any such container,
decodes the sample tables of every track, and gives codec, duration and the byte ranges of key frames. Payloads are never
decoded: only box headers and tables are read, and payload bytes are located by the tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import shared_folder, table, texts

UNIT = 64  # bytes of a sample: 8 ms at 8,000 8-bit samples a second
RATE = 8000
KEY_EVERY = 16
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"})
IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = 8 + len(body)
    return (struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def clock(kind: bytes, between: bytes, duration: int, *rest: bytes, flags: int = 0) -> bytes:
    """A header with times: of version 1, with 64 bits, where the duration needs them."""
    wide = duration >> 32 > 0
    return box(kind, struct.pack(">I", (1 << 24 if wide else 0) | flags), bytes(16 if wide else 8), between, struct.pack(">Q" if wide else ">I", duration), *rest)


def encode(payload: bytes, unit: int = UNIT, rate: int = RATE, key_every: int = KEY_EVERY, chunk: int = 64) -> bytes:
    """A container with one track of 8-bit PCM (ipcm) whose media data is the payload; len(payload) is a multiple of unit."""
    n = len(payload) // unit
    chunks = -(-n // chunk)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    entry = box(b"ipcm", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16), full(b"pcmC", struct.pack(">BB", 1, 8)))
    last = n - (chunks - 1) * chunk if chunks else 0
    runs = [(1, chunk, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks > 0) if last != chunk else [(1, chunk, 1)] * (chunks > 0)
    keys = np.arange(1, n + 1, key_every, dtype=">u4")
    wide = len(payload) >= 1 << 31

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * chunk * unit
        tables = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">I", n > 0), struct.pack(">II", n, unit) if n else b""),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()), full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", unit, n)), full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables)
        mdia = box(b"mdia", clock(b"mdhd", struct.pack(">I", rate), n * unit, struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = clock(b"tkhd", struct.pack(">II", 1, 0), n * unit, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), IDENTITY, bytes(8), flags=7)
        mvhd = clock(b"mvhd", struct.pack(">I", rate), n * unit, struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), IDENTITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + box(b"mdat", payload)


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes in data[at:end]; a damaged size ends the walk."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            return
        yield bytes(kind), body, at + size
        at += size


def tree(data: memoryview, at: int, end: int) -> dict[bytes, list]:
    """Boxes by kind, at any depth; nested ones as trees, the others as (start, end)."""
    root: dict[bytes, list] = {}
    todo = [(root, at, end)]
    while todo:
        found, at, end = todo.pop()
        for kind, a, b in boxes(data, at, end):
            inner: dict[bytes, list] = {}
            found.setdefault(kind, []).append(inner if kind in CONTAINERS else (a, b))
            if kind in CONTAINERS:
                todo.append((inner, a, b))
    return root


def numbers(data: memoryview, at: int, count: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def track(data: memoryview, trak: dict[bytes, list]) -> dict:
    """Codec, time scale, duration and sample places of a track."""
    mdia = trak[b"mdia"][0]
    at, _ = mdia[b"mdhd"][0]
    version = data[at]
    scale, duration = struct.unpack_from(">IQ" if version else ">II", data, at + (20 if version else 12))
    stbl = mdia[b"minf"][0][b"stbl"][0]
    at, _ = stbl[b"stsd"][0]
    codec = bytes(data[at + 12 : at + 16]).decode("latin-1").strip()
    at, _ = stbl[b"stts"][0]
    times = numbers(data, at + 8, 2 * struct.unpack_from(">I", data, at + 4)[0], ">u4").reshape(-1, 2)
    at, _ = stbl[b"stsz"][0]
    size, n = struct.unpack_from(">II", data, at + 4)
    if size * n > len(data):
        raise ValueError("more samples than bytes")
    sizes = np.full(n, size, np.int64) if size else numbers(data, at + 12, n, ">u4")
    wide = b"co64" in stbl
    at, _ = stbl[b"co64" if wide else b"stco"][0]
    chunks = numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u8" if wide else ">u4")
    at, _ = stbl[b"stsc"][0]
    runs = numbers(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0], ">u4").reshape(-1, 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(runs) else np.zeros(0, np.int64)
    chunk_of = np.repeat(np.arange(len(per)), per)[:n]
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    starts = chunks[chunk_of] + before - before[first[chunk_of]] if n else np.zeros(0, np.int64)
    if b"stss" in stbl:
        at, _ = stbl[b"stss"][0]
        keys = numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u4") - 1
    else:
        keys = np.arange(n)
    return {"count": n, "codec": codec, "scale": scale, "duration": duration, "ticks": int((times[:, 0] * times[:, 1]).sum()), "starts": starts, "ends": starts + sizes, "keys": keys}


def readable(data: memoryview, trak: dict[bytes, list]) -> dict | None:
    """What track() gives; None where a box is missing or short, or the tables don't fit together or point outside the container."""
    try:
        t = track(data, trak)
        fits = t["scale"] > 0 and len(t["ends"]) == t["count"] and (not t["count"] or t["starts"].min() >= 0 and t["ends"].max() <= len(data)) and (not len(t["keys"]) or 0 <= t["keys"].min() and t["keys"].max() < t["count"])
        return t if fits else None
    except (KeyError, IndexError, ValueError, TypeError, struct.error, OverflowError, MemoryError):
        return None


def describe(media: bytes) -> list[dict]:
    """A dictionary for each readable track of a container; [] where there is none. A damaged track is left out, the others stay."""
    data = memoryview(media)
    found = tree(data, 0, len(data))
    return [t for moov in found.get(b"moov", []) for x in moov.get(b"trak", []) if (t := readable(data, x)) is not None]


def samples(media: bytes, t: dict) -> bytes:
    """The stored bytes of a track in sample order; touching samples are taken as one slice."""
    if not len(t["starts"]):
        return b""
    breaks = np.flatnonzero(t["starts"][1:] != t["ends"][:-1]) + 1
    a, b = t["starts"][np.concatenate([[0], breaks])], t["ends"][np.concatenate([breaks - 1, [-1]])]
    return b"".join(media[x:y] for x, y in zip(a.tolist(), b.tolist()))


def feature(t: dict) -> str:
    """codec;seconds;samples;number of key frames;first and last key range;CRC-32 of all key ranges."""
    ranges = np.stack([t["starts"][t["keys"]], t["ends"][t["keys"]]], 1).astype("<i8") if len(t["keys"]) else np.zeros((0, 2), "<i8")
    ends = ",".join(f"{a}-{b}" for a, b in ranges[[0, -1]].tolist()) if len(ranges) else ""
    return f"{t['codec']};{t['duration'] / t['scale']:.3f};{len(t['starts'])};{len(ranges)};{ends};{zlib.crc32(ranges.tobytes()):08x}"


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container column `media` of docs (doc_id, text); null text is empty."""

    @F.pandas_udf("binary")
    def made(text: pd.Series) -> pd.Series:
        return pd.Series([encode(padded(t)) for t in texts(text)], dtype=object)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), made(text).alias("media"))


TRACK = "struct<codec:string,seconds:double,samples:long,key_starts:array<long>,key_ends:array<long>>"


def stored_track(t: dict) -> dict:
    """What the column `tracks` holds of a track: the byte ranges of all its key frames too."""
    return {"codec": t["codec"], "seconds": t["duration"] / t["scale"], "samples": len(t["starts"]), "key_starts": t["starts"][t["keys"]].tolist(), "key_ends": t["ends"][t["keys"]].tolist()}


def media_features(frame: DataFrame) -> DataFrame:
    """Replaces the column `media` by what its tracks tell: `tracks` has each of them with all key ranges, the digests are of the first.

    A container without a track, or a null one, has no tracks, payload_bytes 0, the sums of no bytes and a null feature. Equal
    containers give equal values; rows are independent, so there is no exchange and repeated rows stay. A damaged track counts as
    missing and fails nothing. No rows give no rows; other columns stay, but those named as the new ones give way to them.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tracks"]

    @F.pandas_udf(f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tracks array<{TRACK}>")
    def read(media: pd.Series) -> pd.DataFrame:
        out = []
        for m in media:
            m = bytes(m) if m is not None else b""
            tracks = describe(m)
            payload = samples(m, tracks[0]) if tracks else b""
            digests = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest()
            out.append((*digests, feature(tracks[0]) if tracks else None, [stored_track(t) for t in tracks]))
        return pd.DataFrame(out, columns=names)

    rest = [F.col(f"`{c}`") for c in frame.columns if c not in ("media", *names)]
    return frame.select(F.struct(*rest).alias("own"), read("media").alias("told")).select("own.*", "told.*")


def store_media(docs: DataFrame, path: str) -> DataFrame:
    """Writes the containers of docs as a Parquet column `media` below path and reads it back. A cell holds 2 GB at most, so the
    longest text is a little shorter; null and empty texts give a container of one sample of zeros."""
    frame = with_media(docs)
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(frame.schema).parquet(path)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(table(spark, sf_dir, "documents"), shared_folder(spark, "media"))).drop("tracks")
