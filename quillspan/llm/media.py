"""Texts as PNG images in binary columns: encoder, checked decoder and low-frequency cosine hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import short_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Raw bytes that are compressed into one IDAT chunk.
IDAT_BYTES = 1 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """The rows of an 8-bit grey image under one of the five PNG filters, each with its filter's number first."""
    left = np.pad(image, ((0, 0), (1, 0)))[:, :-1].astype(np.int16)
    up = np.pad(image, ((1, 0), (0, 0)))[:-1].astype(np.int16)
    corner = np.pad(image, ((1, 0), (1, 0)))[:-1, :-1].astype(np.int16)
    guess = [0, left, up, (left + up) // 2, _paeth(left, up, corner)][kind]
    body = ((image.astype(np.int16) - guess) & 255).astype(np.uint8)
    return np.concatenate([np.full((len(image), 1), kind, np.uint8), body], 1)


def _paeth(a, b, c):
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def chosen_filters(image: np.ndarray) -> np.ndarray:
    """Each row under that of the filters none, left and up whose differences, taken as signed, have the smallest sum; of equal ones the first."""
    tried = np.empty((3, *image.shape), np.uint8)
    tried[0], tried[1, :, 0], tried[2, 0] = image, image[:, 0], image[0]
    np.subtract(image[:, 1:], image[:, :-1], out=tried[1, :, 1:])
    np.subtract(image[1:], image[:-1], out=tried[2, 1:])
    kind = np.abs(tried.view(np.int8)).view(np.uint8).sum(2, dtype=np.int32).argmin(0)
    return np.concatenate([kind[:, None].astype(np.uint8), tried[kind, np.arange(len(image))]], 1)


def encode_png(payload: bytes, level: int = 1, kind: int | None = None) -> bytes:
    """A grey PNG, 64 samples wide, of a payload of a multiple of 64 bytes, with one filter or each row's own."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0))]
    squeeze, step = zlib.compressobj(level), IDAT_BYTES // (WIDTH + 1)
    for at in range(0, len(image), step):
        part = image[max(0, at - 1) : at + step]
        rows = (chosen_filters(part) if kind is None else filtered(part, kind))[1 if at else 0 :]
        body = squeeze.compress(rows.tobytes()) + (squeeze.flush() if at + step >= len(image) else b"")
        if body:
            out.append(_chunk(b"IDAT", body))
    return b"".join([*out, _chunk(b"IEND", b"")])


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows. Without Average and Paeth rows by sums over whole arrays, else by diagonals."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("PNG: unknown filter")
    if kinds.max(initial=0) > 2:
        return _by_diagonals(kinds, out)
    left = kinds == 1
    if left.any():
        out[left] = np.cumsum(out[left], 1, dtype=np.uint8)
    if (kinds == 2).any():
        # a run of up differences is added to the row above it: running sums over all rows, less the sum before that row
        first = np.maximum.accumulate(np.where(kinds == 2, 0, np.arange(len(out))))
        total = np.cumsum(out, 0, dtype=np.uint8)
        out = total - np.where(first[:, None] > 0, total[first - 1], np.uint8(0))
    return out


def _by_diagonals(kinds: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rows of any filters: all samples whose row and column add up to the same number at once, as each rests on earlier numbers alone."""
    h, w = out.shape
    known = np.zeros((h + 1, w + 1), np.int16)
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        c = d - r
        left, up, corner, kind = known[r + 1, c], known[r, c + 1], known[r, c], kinds[r]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, _paeth(left, up, corner)], 0)
        known[r + 1, c + 1] = (out[r, c] + guess) & 255
    return known[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG that isn't interlaced. ValueError if its signature, a checksum, the order of its chunks or its length is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: no signature")
    at, parts, shape, ended = 8, [], None, False
    while at < len(data):
        if len(data) < at + 12 or ended:
            raise ValueError("PNG: cut off, or data after the end")
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
            raise ValueError("PNG: wrong checksum")
        if (kind == b"IHDR") != (at == 8):
            raise ValueError("PNG: IHDR isn't first")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("PNG: not 8-bit grey")
            shape = height, width + 1
        elif kind == b"IDAT":
            parts.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    raw = zlib.decompress(b"".join(parts)) if ended else b""
    if not shape or len(raw) != shape[0] * shape[1]:
        raise ValueError("PNG: wrong length")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(shape))


def cosine_matrix(n: int) -> np.ndarray:
    """The orthonormal cosine transform of n samples."""
    k, x = np.arange(n)[:, None], np.arange(n)[None]
    out = np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    out[0] /= np.sqrt(2)
    return out


_COSINES = cosine_matrix(32)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: whether each of the 8 x 8 lowest frequencies of the image, averaged down to 32 x 32, is above their median (the constant one aside)."""
    h, w = image.shape
    rows = np.minimum(np.arange(33) * h // 32, h)
    if h >= 32:
        # uint64 sums: whole numbers, so equal for equal images
        tall = np.add.reduceat(image, rows[:-1], 0, dtype=np.uint64) / np.diff(rows)[:, None]
    else:
        tall = image[np.arange(32) * h // 32].astype(np.float64)
    small = tall.reshape(32, 32, w // 32).mean(2)
    low = np.round((_COSINES[:8] @ small @ _COSINES[:8].T).ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: str | None) -> tuple[int, bytes]:
    """A text's bytes, and those filled up with zero bytes to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _stored(batches: Iterator[pa.RecordBatch], level: int, kind: int | None, media: bool) -> Iterator[pa.RecordBatch]:
    """One batch for some 4 MB of text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("phash", pa.binary()), *([("media", pa.binary())] * media)])
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n, body = payload(text.as_py())
            stored = encode_png(body, level, kind)
            image = decode_png(stored)
            back = image.tobytes()
            rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(image), *([stored] * media)))
            held += len(stored)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def media_columns(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", level: int = 1, kind: int | None = None, media: bool = True) -> DataFrame:
    """Each text's UTF-8 bytes as a grey PNG in a binary column, read back and hashed. Each row of an image has its own filter, or all
    that of kind; kind 0, no filter, makes images of plain text a third smaller.

    One row for each row: doc_id, n_bytes, payload_bytes (with zero bytes up to a positive multiple of 64),
    payload_sha256 and tail_crc32 of what decoding the PNG gives, media_bytes, media_sha256, phash (8 bytes: signs of the
    low frequencies of the image's cosine transform) and, if media, the PNG itself in media.

    A null text is an empty one: 64 zero bytes. Equal texts give equal values in all columns but doc_id; rows that
    repeat stay apart. An empty table gives an empty table. Other columns are not read. No shuffle; a task holds one
    Arrow batch, one text and its image.
    """
    short_batches(documents.sparkSession)
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, phash binary" + ", media binary" * media
    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _stored(it, level, kind, media), schema)
