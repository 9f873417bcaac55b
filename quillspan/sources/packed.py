"""Members of 7z and rar archives with the standard library, by the published formats: 7z in its usual methods, rar where members are stored as they are."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

SEVEN, RAR4, RAR5 = b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"


@dataclass
class Reader:
    """Numbers and bytes one after the other."""

    data: bytes
    at: int = 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("archive: cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """As many further bytes as the first one has leading ones; what is left of it stands highest."""
        first = self.byte()
        more = next((k for k in range(8) if not first & 0x80 >> k), 8)
        return int.from_bytes(self.take(more), "little") | ((first & (0x7F >> more)) << 8 * more if more < 7 else 0)

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[k // 8] & 0x80 >> k % 8) for k in range(n)]

    def sevens(self) -> int:
        """Seven bits of each byte, lowest first, as long as the eighth is set."""
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 128:
                return out


def _lzma1(raw: bytes, props: bytes, size: int) -> bytes:
    d = props[0]
    how = {"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": max(4096, struct.unpack("<I", props[1:5])[0])}
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[how]).decompress(raw, size)


def _lzma2(raw: bytes, props: bytes, size: int) -> bytes:
    wide = 0xFFFFFFFF if props[0] >= 40 else (2 | props[0] & 1) << props[0] // 2 + 11
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": wide}]).decompress(raw, size)


#: What undoes a method, by its number. Fixed values.
METHODS = {"00": lambda raw, props, size: raw[:size], "030101": _lzma1, "21": _lzma2, "040108": lambda raw, props, size: zlib.decompressobj(-15).decompress(raw, size), "040202": lambda raw, props, size: bz2.BZ2Decompressor().decompress(raw, size)}


@dataclass
class Folder:
    """What is packed together: methods in the order in which they are undone, and sizes."""

    coders: list[tuple[str, bytes, int]]
    size: int
    offset: int
    packed: int


def _folder(r: Reader) -> tuple[list[tuple[str, bytes]], list[int]]:
    """Methods with their settings, and their places in the order in which they are undone."""
    coders = []
    for _ in range(r.number()):
        flag = r.byte()
        name = r.take(flag & 15).hex()
        if flag & 16:
            raise ValueError("archive: a method of several streams")
        coders.append((name, r.take(r.number()) if flag & 32 else b""))
    # the output of which method is the input of which
    feeds = {out: into for into, out in ((r.number(), r.number()) for _ in range(len(coders) - 1))}
    order = [next(k for k in range(len(coders)) if k not in feeds.values())]
    while order[-1] in feeds:
        order.append(feeds[order[-1]])
    return coders, order


def _digests(r: Reader, n: int) -> None:
    known = [True] * n if r.byte() else r.bits(n)
    r.take(4 * sum(known))


def _streams(r: Reader) -> tuple[list[Folder], list[list[int]]]:
    """Folders, and the sizes of the files in each."""
    offset, packed, folders, sizes = 32, [], [], None
    while (kind := r.byte()) != 0:
        if kind == 6:
            offset += r.number()
            n = r.number()
            while (inner := r.byte()) != 0:
                if inner == 9:
                    packed = [r.number() for _ in range(n)]
                else:
                    _digests(r, n)
        elif kind == 7:
            r.take(1)
            read = _folders(r)
            r.take(1)
            for (coders, order), raw in zip(read, packed, strict=True):
                each = [r.number() for _ in coders]
                folders.append(Folder([(*coders[k], each[k]) for k in order], each[order[-1]], offset, raw))
                offset += raw
            while (inner := r.byte()) != 0:
                _digests(r, len(folders))
        elif kind == 8:
            counts = [1] * len(folders)
            inner = r.byte()
            if inner == 13:
                counts = [r.number() for _ in folders]
                inner = r.byte()
            sizes = []
            for f, n in zip(folders, counts, strict=True):
                some = [r.number() for _ in range(n - 1)] if inner == 9 else []
                sizes.append([*some, f.size - sum(some)] if n else [])
            if inner == 9:
                inner = r.byte()
            if inner == 10:
                _digests(r, sum(n for n in counts if n != 1) or sum(counts))
                inner = r.byte()
    return folders, sizes if sizes is not None else [[f.size] for f in folders]


def _folders(r: Reader) -> list[tuple[list[tuple[str, bytes]], list[int]]]:
    n = r.number()
    r.take(1)
    return [_folder(r) for _ in range(n)]


def _unpacked(data: bytes, folder: Folder) -> bytes:
    raw = data[folder.offset : folder.offset + folder.packed]
    for name, props, size in folder.coders:
        if name == "06f10701":
            raise ValueError("encrypted")
        if name not in METHODS:
            raise ValueError(f"archive: method {name}")
        raw = METHODS[name](raw, props, size)
    if len(raw) != folder.size:
        raise ValueError("archive: wrong length")
    return raw


def seven_members(data: bytes, most: int) -> Iterator[tuple[str, bytes | str]]:
    """Names and contents of a 7z archive's files; a reason in place of contents that can't be read or are larger than most."""
    if data[:6] != SEVEN:
        raise ValueError("not a 7z archive")
    place, size, _ = struct.unpack_from("<QQI", data, 12)
    r = Reader(data[32 + place : 32 + place + size])
    while size and (kind := r.byte()) == 0x17:
        folders, _ = _streams(r)
        r = Reader(_unpacked(data, folders[0]))
    if not size or kind != 1:
        return
    folders, sizes, names, empty = [], [], [], []
    while (kind := r.byte()) != 0:
        if kind == 4:
            folders, sizes = _streams(r)
        elif kind == 5:
            n = r.number()
            while (inner := r.byte()) != 0:
                body = Reader(r.take(r.number()))
                if inner == 14:
                    empty = body.bits(n)
                elif inner == 17:
                    body.take(1)
                    names = body.data[1:].decode("utf-16-le", "replace").split("\0")[:n]
    full = iter([name for name, none in zip(names, empty or [False] * len(names), strict=True) if not none])
    for folder, each in zip(folders, sizes, strict=True):
        try:
            body = f"larger than {most} bytes" if folder.size > most else _unpacked(data, folder)
        except (ValueError, lzma.LZMAError, OSError, zlib.error) as e:
            body = str(e)
        at = 0
        for n in each:
            yield next(full), body if isinstance(body, str) else body[at : at + n]
            at += n


def rar_members(data: bytes, most: int) -> Iterator[tuple[str, bytes | str]]:
    """Names and contents of a rar archive's files; a reason in place of contents that are compressed or larger than most."""
    if data[:8] == RAR5:
        at = 8
        while at + 7 < len(data):
            r = Reader(data, at + 4)
            length = r.sevens()
            end = r.at + length
            kind, flags = r.sevens(), r.sevens()
            _, body = r.sevens() if flags & 1 else 0, r.sevens() if flags & 2 else 0
            if kind == 5:
                return
            if kind == 4:
                raise ValueError("encrypted")
            if kind == 2:
                what, size, _ = r.sevens(), r.sevens(), r.sevens()
                r.take(4 * bool(what & 2) + 4 * bool(what & 4))
                method, _ = r.sevens() >> 7 & 7, r.sevens()
                name = r.take(r.sevens()).decode("utf-8", "replace")
                if not what & 1:
                    yield name, "compressed rar" if method else f"larger than {most} bytes" if size > most else data[end : end + body]
            at = end + body
    elif data[:7] == RAR4:
        at = 7
        while at + 7 <= len(data):
            kind, flags, length = struct.unpack_from("<BHH", data, at + 2)
            body = struct.unpack_from("<I", data, at + 7)[0] if flags & 0x8000 or kind == 0x74 else 0
            if kind == 0x7B or length < 7:
                return
            if kind == 0x73 and flags & 0x80:
                raise ValueError("encrypted")
            if kind == 0x74:
                size, method, n = struct.unpack_from("<I10xBH", data, at + 11)
                high = 8 if flags & 0x100 else 0
                if high:
                    body += struct.unpack_from("<I", data, at + 32)[0] << 32
                raw = data[at + 32 + high : at + 32 + high + n]
                name = raw.split(b"\0")[0].decode("utf-8", "replace").replace("\\", "/")
                if flags & 0xE0 != 0xE0:
                    yield name, "encrypted" if flags & 4 else "compressed rar" if method != 0x30 else f"larger than {most} bytes" if size > most else data[at + length : at + length + body]
            at += length + body
    else:
        raise ValueError("not a rar archive")
