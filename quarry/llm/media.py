"""op8, media columns: text payloads as PNG images, and low-frequency cosine-transform hashes of them.

Each text (UTF-8, null: empty) is padded with bytes 255 to a positive multiple of 576 and stored losslessly as a greyscale PNG of
8-bit samples, 576 to a row. The file is built from chunks by hand: signature, IHDR, one zlib stream in IDAT, IEND, each with its
CRC-32. The reader tests every checksum (CRC of each chunk, Adler-32 inside zlib), undoes the row filters with numpy and returns the
samples. The feature is a 64-bit hash: the image reduced to 32 x 32 by exact integer box sums, its 8 x 8 lowest cosine
coefficients compared with their median.

Edge cases: null and empty texts make one row of 255; equal texts give equal bytes and features; a text of any length is one
image (rows are added); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import texts

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, phash binary"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A greyscale image of the payload. Each row takes the filter (none, sub or up) with the smallest sum of signed residuals."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    options = np.stack([rows, rows - left, rows - above])
    best = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int32).argmin(axis=0)
    raw = np.empty((len(rows), width + 1), np.uint8)
    raw[:, 0] = best
    raw[:, 1:] = options[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(row: np.ndarray, above: np.ndarray) -> None:
    a = c = 0
    for i, b in enumerate(above.tolist()):
        p = a + b - c
        pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        a = row[i] = (int(row[i]) + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
        c = b


def _average(row: np.ndarray, above: np.ndarray) -> None:
    a = 0
    for i, b in enumerate(above.tolist()):
        a = row[i] = (int(row[i]) + (a + b) // 2) & 255


def decode_png(media: bytes) -> np.ndarray:
    """The samples (height, width) of an 8-bit greyscale image without interlace. Raises ValueError where a check fails."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head, ended = 8, [], None, False
    while at < len(media):
        if len(media) < at + 12:
            raise ValueError("truncated chunk")
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if len(media) < at + 12 + n:
            raise ValueError("truncated chunk")
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("unsupported or incomplete image")
    width, height = head[:2]
    try:
        stream = zlib.decompress(b"".join(data))  # tests its Adler-32
    except zlib.error as e:
        raise ValueError("damaged zlib stream") from e
    if len(stream) != height * (width + 1):
        raise ValueError("wrong number of samples")
    raw = np.frombuffer(stream, np.uint8).reshape(height, width + 1)
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown row filter")
    sub = kinds == 1
    if sub.any():  # rows of this kind depend on themselves alone
        out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for i, j in zip([0, *edges], [*edges, height], strict=True):
        kind = kinds[i] if height else 0
        if kind == 2:
            np.cumsum(out[max(i - 1, 0) : j], axis=0, dtype=np.uint8, out=out[max(i - 1, 0) : j])
        elif kind in (3, 4):
            for k in range(i, j):
                (_average if kind == 3 else _paeth)(out[k], out[k - 1] if k else np.zeros(width, np.uint8))
    return out


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1)[None, :] * np.arange(low)[:, None] / (2 * n))


_LOW = _cosines(32, 8)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 reduction exceed their median (the mean, coefficient 0, left out)."""
    h, w = image.shape
    cols = image.reshape(h, 32, w // 32).sum(axis=2, dtype=np.int64) if w % 32 == 0 else np.add.reduceat(image, np.arange(32) * w // 32, axis=1, dtype=np.int64)
    at = np.minimum(np.arange(32) * h // 32, h - 1)
    sums = np.zeros((h + 1, 32), np.int64)
    np.cumsum(cols, axis=0, out=sums[1:])
    to = np.maximum(np.append(at[1:], h), at + 1)
    small = (sums[to] - sums[at]) / ((to - at)[:, None] * (w / 32))
    low = np.rint((_LOW @ small @ _LOW.T).ravel() * 1024)
    return np.packbits(low > np.median(low[1:])).tobytes()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text in batch.column("text"):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            payload = raw + b"\xff" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))
            media = encode_png(payload)
            image = decode_png(media)
            back = image.tobytes()
            phash = cosine_hash(image)
            out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), phash.hex(), phash))
        columns = [list(x) for x in zip(*out, strict=True)] if out else [[] for _ in range(8)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def media_features(docs: DataFrame) -> DataFrame:
    """One row per document with the digests of its image and its cosine hash."""
    return texts(docs).mapInArrow(_rows, SCHEMA)


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text"):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            out.append(encode_png(raw + b"\xff" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """The images themselves: doc_id, media (binary)."""
    return texts(docs).mapInArrow(_images, "doc_id long, media binary")
