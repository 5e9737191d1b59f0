"""Media columns in ISO base media containers, written and read without a codec.

``pack`` stores a payload losslessly as raw 8-bit samples of 64 bytes in a container: ftyp, moov with
one track and its sample tables, mdat. ``boxes`` walks nested boxes; ``describe`` reads the sample
tables of every track (stsd, stts, stsc, stsz, stco or co64, stss) and gives codec, duration, the byte
range of every chunk's samples and of each keyframe, without touching the payload; ``payload`` takes the
bytes that the ranges name, and ``sample_feature`` says how they sound: level, power, peak, changes of sign around the
level and the most common value. A keyframe starts every ``KEY_EVERY`` samples.

Nulls: a null text is empty (its payload: one sample of zeros). Null ids are kept. Empty table: empty
result. Repeated rows give equal rows. Other columns are ignored. Rows are handled one by one, so
memory holds one text and its container. A malformed container is an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of

SAMPLE, KEY_EVERY, TIMESCALE, CHUNK_SAMPLES = 64, 32, 8000, 1024
#: Boxes that hold boxes (fixed by the format).
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(text: bytes) -> bytes:
    """Zeros up to a positive multiple of SAMPLE."""
    return text + bytes(max(SAMPLE, -(-len(text) // SAMPLE) * SAMPLE) - len(text))


def pack(data: bytes) -> bytes:
    n = len(data) // SAMPLE
    chunks = -(-n // CHUNK_SAMPLES)
    last = n - (chunks - 1) * CHUNK_SAMPLES
    ticks = n * SAMPLE
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    runs = [(1, CHUNK_SAMPLES)] * (chunks > 1) + [(chunks, last)]
    tables = [
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, n, SAMPLE)),
        full_box(b"stss", struct.pack(">I", -(-n // KEY_EVERY)), np.arange(1, n + 1, KEY_EVERY, dtype=">u4").tobytes()),
        full_box(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", first, per, 1) for first, per in runs)),
        full_box(b"stsz", struct.pack(">II", SAMPLE, n)),
    ]

    def moov(at: int) -> bytes:
        offsets = at + np.arange(chunks, dtype=np.int64) * CHUNK_SAMPLES * SAMPLE
        stbl = box(b"stbl", *tables, full_box(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()))
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks & 0xFFFFFFFF, 0x55C4, 0))
        hdlr = full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"text\0")
        tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks & 0xFFFFFFFF), bytes(16), matrix, bytes(8), flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    head = 8 if len(data) + 8 < 1 << 32 else 16
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + box(b"mdat", data)


def boxes(data: bytes, lo: int = 0, hi: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, start of the body, end) of every box, nested ones after their parent."""
    hi = len(data) if hi is None else hi
    while lo < hi:
        if hi - lo < 8:
            raise ValueError(f"{hi - lo} stray bytes at {lo}")
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise ValueError(f"box {kind!r} at {lo} has size {size}")
        yield (*path, kind), lo + head, lo + size
        if kind in NESTED:
            yield from boxes(data, lo + head, lo + size, (*path, kind))
        lo += size


def describe(data: bytes) -> list[dict]:
    """A dict for each track: codec, timescale, ticks, n_samples, starts and sizes of samples (arrays), keys (sample numbers from 0)."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, lo, hi in boxes(data):
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and path[:2] == (b"moov", b"trak"):
            tracks[-1][path[-1]] = (lo, hi)
    return [_track(data, t) for t in tracks]


def _table(data: bytes, at: int, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    return np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def _track(data: bytes, t: dict[bytes, tuple[int, int]]) -> dict:
    lo = t[b"mdhd"][0]
    timescale = struct.unpack_from(">I", data, lo + (20 if data[lo] else 12))[0]
    codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1").strip()
    fixed, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
    sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, t[b"stsz"][0] + 12).astype(np.int64)
    chunks = (_table(data, t[b"co64"][0], 1, ">u8") if b"co64" in t else _table(data, t[b"stco"][0], 1))[:, 0]
    runs = _table(data, t[b"stsc"][0], 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))  # samples of each chunk
    if per.sum() != n:
        raise ValueError(f"chunks hold {per.sum()} samples, the size table {n}")
    chunk = np.repeat(np.arange(len(chunks)), per)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    starts = chunks[chunk] + before - before[first[chunk]] if n else before
    times = _table(data, t[b"stts"][0], 2)
    keys = _table(data, t[b"stss"][0], 1)[:, 0] - 1 if b"stss" in t else np.arange(n)
    return {"codec": codec, "timescale": timescale, "ticks": int((times[:, 0] * times[:, 1]).sum()), "n_samples": n, "starts": starts, "sizes": sizes, "keys": keys}


def key_ranges(track: dict) -> list[tuple[int, int]]:
    """(offset, length) of each keyframe's sample."""
    k = track["keys"]
    return list(zip(track["starts"][k].tolist(), track["sizes"][k].tolist()))


def payload(data: bytes, track: dict) -> bytes:
    """The track's samples in order; neighbours are read at once."""
    starts, ends = track["starts"], track["starts"] + track["sizes"]
    cuts = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    lo, hi = np.r_[0, cuts], np.r_[cuts, len(starts)] - 1
    return b"".join(data[starts[a] : ends[b]] for a, b in zip(lo, hi)) if len(starts) else b""


def sample_feature(back: bytes) -> str:
    """Of unsigned 8-bit samples: mean and mean square, largest, crossings of the mean, and the most common value; in whole numbers."""
    x = np.frombuffer(back, np.uint8)
    n = np.bincount(x, minlength=256)
    values = np.arange(256)
    total = int((n * values).sum())
    above = x.astype(np.int64) * len(x) >= total
    crossings = int((above[1:] != above[:-1]).sum())
    return f"mean={total // len(x)} power={int((n * values * values).sum()) // len(x)} peak={int(n.nonzero()[0].max())} crossings={crossings} mode={int(n.argmax())}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, payload_*, tail_crc32, media_*, codec, duration, key_ranges, feature; with keep_media also the container."""
    schema = (
        "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "codec string, duration double, n_keyframes long, feature string, key_ranges array<struct<offset:long,length:long>>" + ", media binary" * keep_media
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def row(text: str) -> tuple:
        raw = text.encode()
        media = pack(padded(raw))
        (track,) = describe(media)
        back, ranges = payload(media, track), key_ranges(track)
        duration = track["ticks"] / track["timescale"]
        feature = f"{track['codec']}/{track['timescale']} ticks={track['ticks']} samples={track['n_samples']} keyframes={len(ranges)} {sample_feature(back)}"
        return (
            len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLE:]), len(media), hashlib.sha256(media).hexdigest(),
            track["codec"], duration, len(ranges), feature, ranges,
        ) + (media,) * keep_media

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(i, *row(t)) for i, t in zip(ids_of(pdf["id"]), pdf["text"])], columns=names)

    return docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(fill, schema)
