"""Compound files: their streams, and the texts of legacy documents, workbooks and presentations in them, by the published formats."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

#: First bytes of a compound file, and marks in its sector chains. Fixed values.
MAGIC, END, FREE = bytes.fromhex("D0CF11E0A1B11AE1"), 0xFFFFFFFE, 0xFFFFFFFF
#: Field marks of a document's text: what stands between the first two is an instruction. Fixed values.
FIELD_BEGIN, FIELD_RESULT, FIELD_END = "\x13", "\x14", "\x15"


def _chain(table: list[int], first: int) -> Iterator[int]:
    for _ in range(len(table)):
        if first >= len(table):
            return
        yield first
        first = table[first]
    if first < len(table):
        raise ValueError("compound file: a chain runs in a circle")


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by their path in it. ValueError if it isn't one."""
    if data[:8] != MAGIC or len(data) < 512:
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, limit, small_fat, _, more, n_more = struct.unpack_from("<I4xIIIII", data, 48)
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    numbers = lambda raw: struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    places = list(struct.unpack_from("<109I", data, 76))
    for _ in range(n_more):
        *listed, more = numbers(sector(more))
        places += listed
    table = [x for k in places if k < FREE - 5 for x in numbers(sector(k))]
    read = lambda first: b"".join(map(sector, _chain(table, first)))
    entries = read(directory)
    found = []
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        left, right, child, first, total = struct.unpack_from("<III36xII", entries, at + 68)
        found.append((entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), kind, left, right, child, first, total))
    minis = [x for x in numbers(read(small_fat))] if small_fat < END else []
    pool = read(found[0][5]) if found and found[0][5] < END else b""
    out, todo, seen = {}, [(found[0][4], "")] if found else [], set()
    while todo:
        k, path = todo.pop()
        if k >= len(found) or k in seen:
            continue
        seen.add(k)
        name, kind, left, right, child, first, total = found[k]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2:
            body = b"".join(pool[j * small : (j + 1) * small] for j in _chain(minis, first)) if total < limit else read(first) if total else b""
            out[path + name] = body[:total]
    return out


def _without_fields(text: str) -> str:
    out, instructions = [], []
    for c in text:
        if c == FIELD_BEGIN:
            instructions.append(True)
        elif c == FIELD_RESULT and instructions:
            instructions[-1] = False
        elif c == FIELD_END and instructions:
            instructions.pop()
        elif not any(instructions):
            out.append(c)
    return "".join(out)


def doc_texts(parts: dict[str, bytes]) -> list[str]:
    """Paragraphs of a document, with its notes and comments after the main text, by the pieces that its table lists."""
    main = parts["WordDocument"]
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x0100:
        raise ValueError("encrypted")
    table = parts["1Table" if flags & 0x0200 else "0Table"]
    at, length = struct.unpack_from("<II", main, 418)
    clx, text = table[at : at + length], []
    while clx[:1] == b"\x01":
        clx = clx[3 + struct.unpack_from("<H", clx, 1)[0] :]
    plc = clx[5 : 5 + struct.unpack_from("<I", clx, 1)[0]]
    n = (len(plc) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plc)
    for k in range(n):
        place, count = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0], ends[k + 1] - ends[k]
        if place & 1 << 30:
            start = (place & ~(1 << 30)) // 2
            text.append(main[start : start + count].decode("cp1252", "replace"))
        else:
            text.append(main[place : place + 2 * count].decode("utf-16-le", "replace"))
    return [s for p in re.split("[\r\x07\x0b\x0c]", _without_fields("".join(text))) if (s := re.sub("[\x00-\x08\x0e-\x1f]", "", p).strip())]


def _records(book: bytes) -> list[tuple[int, list[bytes]]]:
    """Records of a workbook, each with what continues it."""
    out, at = [], 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        body = book[at + 4 : at + 4 + size]
        if kind == 0x003C and out:
            out[-1][1].append(body)
        else:
            out.append((kind, [body]))
        at += 4 + size
    return out


class _Parts:
    """Reads over the joints of continued records; characters after a joint begin with their own width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            part = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + part, n - len(part), self.at + len(part)
            if self.at >= len(self.parts[self.k]) and n:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self, count: int, wide: bool) -> str:
        out = ""
        while count and self.k < len(self.parts):
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                wide = bool(self.take(1)[:1] == b"\x01")
            n = min(count, (len(self.parts[self.k]) - self.at) // (2 if wide else 1))
            if not n:
                break
            out += self.take(n * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace")
            count -= n
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3).ljust(3, b"\0"))
        runs = struct.unpack("<H", self.take(2).ljust(2, b"\0"))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4).ljust(4, b"\0"))[0] if flags & 4 else 0
        out = self.text(count, bool(flags & 1))
        self.take(4 * runs + extra)
        return out


def _rk(raw: int) -> float:
    value = float(raw >> 2 if raw < 1 << 31 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & ~3) << 32))[0]
    return value / 100 if raw & 1 else value


def xls_cells(parts: dict[str, bytes]) -> Iterator[tuple[str, bool, int, int, str | float]]:
    """Sheet, whether it is hidden, row, column and value of the cells of a workbook, in order."""
    book = parts.get("Workbook") or parts["Book"]
    shared, sheets = [], {}
    records = _records(book)
    for kind, body in records:
        if kind == 0x002F:
            raise ValueError("encrypted")
        if kind == 0x0085:
            place, state, _, length, wide = struct.unpack_from("<IBBBB", body[0])
            sheets[place] = (body[0][8 : 8 + length * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1", "replace"), bool(state & 3))
        elif kind == 0x00FC:
            held = _Parts(body)
            shared = [held.string() for _ in range(struct.unpack("<II", held.take(8))[1])]
    at, sheet, pending = 0, None, None
    for kind, body in records:
        b = body[0]
        if kind == 0x0809:
            sheet = sheets.get(at)
        at += sum(4 + len(x) for x in body)
        if sheet is None or len(b) < 6 and kind != 0x0207:
            continue
        row, col = struct.unpack_from("<HH", b) if len(b) >= 4 else (0, 0)
        if kind == 0x00FD:
            yield *sheet, row, col, shared[struct.unpack_from("<I", b, 6)[0]]
        elif kind == 0x0203:
            yield *sheet, row, col, struct.unpack_from("<d", b, 6)[0]
        elif kind == 0x027E:
            yield *sheet, row, col, _rk(struct.unpack_from("<I", b, 6)[0])
        elif kind == 0x00BD:
            for k in range((len(b) - 6) // 6):
                yield *sheet, row, col + k, _rk(struct.unpack_from("<I", b, 6 + 6 * k)[0])
        elif kind == 0x0204:
            held = _Parts([b[6:]])
            yield *sheet, row, col, held.string()
        elif kind == 0x0006:
            if b[12:14] == b"\xff\xff":
                pending = (row, col) if b[6] == 0 else None
            else:
                yield *sheet, row, col, struct.unpack_from("<d", b, 6)[0]
        elif kind == 0x0207 and pending:
            yield *sheet, *pending, _Parts(body).string()
            pending = None


def ppt_texts(parts: dict[str, bytes]) -> Iterator[tuple[str, str]]:
    """What kind of page (slide, notes or master) shows a text, and the text, of a presentation, in the order of its records."""
    data = parts["PowerPoint Document"]
    todo = [(0, len(data), "")]
    while todo:
        at, end, page = todo.pop()
        while at + 8 <= end:
            version, kind, size = struct.unpack_from("<HHI", data, at)
            start, at = at + 8, at + 8 + size
            if kind in (0x0FA0, 0x0FA8):
                text = data[start:at].decode("utf-16-le" if kind == 0x0FA0 else "latin-1", "replace")
                for line in re.split("[\r\n\x0b]", text):
                    if line.strip():
                        yield page or "slide", line.strip()
            elif version & 15 == 15:
                todo += [(at, end, page), (start, min(at, end), {0x03EE: "slide", 0x03F0: "notes", 0x03F8: "master"}.get(kind, page))]
                break


def _cell_text(value: str | float) -> str:
    from quillspan.sources.office import dated

    return value if isinstance(value, str) else dated(repr(value))


def doc_units(data: bytes) -> Iterator[dict]:
    for text in doc_texts(streams(data)):
        yield {"kind": "p", "text": text}


def xls_units(data: bytes) -> Iterator[dict]:
    for sheet, hidden, row, col, value in xls_cells(streams(data)):
        if _cell_text(value).strip():
            yield {"kind": "cell", "sheet": sheet, "hidden": hidden, "row": row, "col": col, "text": _cell_text(value).strip()}


def ppt_units(data: bytes) -> Iterator[dict]:
    """Texts of slides, then notes, which count as hidden; what masters show is left out."""
    found = list(ppt_texts(streams(data)))
    for page, text in [x for x in found if x[0] == "slide"] + [x for x in found if x[0] == "notes"]:
        yield {"kind": "note" if page == "notes" else "p", "hidden": page == "notes", "text": text}


def object_units(data: bytes) -> Iterator[dict]:
    """Units of an object embedded in another file: an Office package or legacy document within a compound file, or such a package itself. Of a workbook the sheet that is shown."""
    from quillspan.sources.office import EXTRACTORS, active_sheet

    start = data.find(MAGIC)
    parts = streams(data[start:]) if start >= 0 else {}
    packed = next((b[b.find(b"PK\x03\x04") :] for n, b in parts.items() if n.rpartition("/")[2] in ("Package", "CONTENTS") and b"PK\x03\x04" in b), b"")
    packed = packed or (data[data.find(b"PK\x03\x04") :] if not parts and b"PK\x03\x04" in data else b"")
    if packed:
        names = set(zipfile.ZipFile(io.BytesIO(packed)).namelist())
        kind = next((k for k, n in (("xlsx", "xl/workbook.xml"), ("docx", "word/document.xml"), ("pptx", "ppt/presentation.xml")) if n in names), None)
        shown = active_sheet(packed) if kind == "xlsx" else None
        for unit in EXTRACTORS[kind](packed) if kind else ():
            if unit["kind"] != "title" and (shown is None or unit["sheet"] == shown):
                yield unit
        return
    names = {n.rpartition("/")[2]: n for n in parts}
    inner = {leaf: parts[n] for leaf, n in names.items()}
    if "Workbook" in inner or "Book" in inner:
        yield from ({"kind": "cell", "sheet": s, "hidden": h, "row": r, "col": c, "text": _cell_text(v).strip()} for s, h, r, c, v in xls_cells(inner) if _cell_text(v).strip())
    elif "WordDocument" in inner:
        yield from ({"kind": "p", "text": t} for t in doc_texts(inner))
    elif "PowerPoint Document" in inner:
        yield from ({"kind": "p", "text": t} for page, t in ppt_texts(inner) if page == "slide")
