"""Texts and images found in bytes of unknown structure, and media inside Office packages."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least characters of a run, and the shares of Chinese characters that it must have.
LEAST_RUN, UTF16_SHARE, GBK_SHARE, GBK_LEAST, GBK_COMMON, GBK_GAP = 4, 0.6, 0.7, 8, 2, 4
#: Very frequent Chinese characters, of which real text has some. A fixed value.
COMMON_HAN = set("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经")
#: First bytes of image formats, in hexadecimal. Fixed values.
IMAGE_HEADS = {"png": "89504E470D0A1A0A", "jpg": "FFD8FF", "gif": "47494638", "bmp": "424D", "tiff": "49492A00", "tif": "4D4D002A", "emf": "01000000", "wmf": "D7CDC69A"}

STRICT = "㐀-䶿一-鿿\U00020000-\U0002ffff"
GLUE = "！-～　-〿—-”…‧·"
_RUN = re.compile(f"[ -~{STRICT}{GLUE}]{{{LEAST_RUN},}}")
_STRICT = re.compile(f"[{STRICT}]")
_GBK_PAIRS = re.compile(rb"(?:[\x81-\xfe][\x40-\xfe])+")
_WORDS = re.compile(rb"[\x20-\x7e]{4,}")


def utf16_runs(data: bytes) -> list[str]:
    """Distinct runs of text in little-endian UTF-16 of which most characters are Chinese, in order."""
    found = (m[0] for m in _RUN.finditer(data.decode("utf-16-le", "ignore")))
    kept = (s.strip() for s in found if len(_STRICT.findall(s)) >= UTF16_SHARE * len(s))
    return list(dict.fromkeys(s for s in kept if s))


def gbk_runs(data: bytes) -> list[str]:
    """Distinct texts in GBK: pairs of bytes with gaps of a few bytes at most, of which most are Chinese characters and some frequent ones."""
    spans: list[list[int]] = []
    for m in _GBK_PAIRS.finditer(data):
        if spans and m.start() - spans[-1][1] <= GBK_GAP:
            spans[-1][1] = m.end()
        else:
            spans.append([m.start(), m.end()])
    out = {}
    for a, b in spans:
        text = data[a:b].decode("gbk", "ignore").strip()
        han = [c for c in text if "一" <= c <= "鿿"]
        if len(text) >= LEAST_RUN and len(han) >= max(GBK_LEAST, GBK_SHARE * len(text)) and sum(c in COMMON_HAN for c in han) >= GBK_COMMON:
            out[text] = None
    return list(out)


def latin_runs(data: bytes) -> list[str]:
    """Distinct runs of printable ASCII that read like words: letters for the most part, with a vowel."""
    found = (m[0].decode().strip() for m in _WORDS.finditer(data))
    plausible = (s for s in found if sum(c.isalpha() or c == " " for c in s) >= 0.7 * max(len(s), 1) and re.search("[aeiouyAEIOUY]", s))
    return list(dict.fromkeys(s for s in plausible if len(s) >= LEAST_RUN))


def carved_units(data: bytes) -> Iterator[dict]:
    """Runs of all three kinds as units; a GBK run only if no UTF-16 text was found, as either coding reads the other's bytes as noise."""
    wide = utf16_runs(data)
    for kind, runs in (("utf16", wide), ("gbk", [] if wide else gbk_runs(data)), ("latin", latin_runs(data))):
        for text in runs:
            yield {"kind": kind, "text": text}


def png_length(data: bytes, at: int) -> int | None:
    """Bytes of the PNG that begins at a place, by its chunks; None if it is cut off."""
    end = at + 8
    while end + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[end : end + 8])
        end += 12 + size
        if kind == b"IEND":
            return end - at if end <= len(data) else None
    return None


def carved_images(data: bytes) -> list[tuple[str, int, int]]:
    """Format, place and length of the PNG and JPEG images in some bytes, which don't overlap."""
    out, at = [], 0
    for m in re.finditer(rb"\x89PNG\r\n\x1a\n|\xff\xd8\xff", data):
        if m.start() < at:
            continue
        png = m[0][:1] == b"\x89"
        stop = -1 if png else data.find(b"\xff\xd9", m.end())
        size = png_length(data, m.start()) if png else stop + 2 - m.start() if stop >= 0 else None
        if size:
            out.append(("png" if png else "jpg", m.start(), size))
            at = m.start() + size
    return out


def media_parts(data: bytes) -> list[tuple[str, str | None, int]]:
    """Name, format by first bytes and size of the media of an Office package, by name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = sorted((i for i in z.infolist() if re.search(r"(^|/)media/[^/]+$", i.filename)), key=lambda i: i.filename)
        out = []
        for info in found:
            with z.open(info) as f:
                head = f.read(8).hex().upper()
            out.append((info.filename, next((k for k, v in IMAGE_HEADS.items() if head.startswith(v)), None), info.file_size))
    return out


def image_kind(content: Column) -> Column:
    """An image's format by its first bytes; null for others."""
    head, kind = F.hex(F.substring(content, 1, 8)), F.lit(None).cast("string")
    for name, start in reversed(IMAGE_HEADS.items()):
        kind = F.when(head.startswith(start), name).otherwise(kind)
    return kind


def media_of_files(files: DataFrame) -> DataFrame:
    """path, name, kind and size of the media in a table of packages with path and content; broken packages have none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows += [(path, *part) for part in media_parts(content.as_py() or b"")]
                except zipfile.BadZipFile:
                    continue
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "name", "kind", "size"])

    return files.select("path", "content").mapInArrow(each, "path string, name string, kind string, size bigint")
