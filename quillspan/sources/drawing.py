"""Texts of drawing-exchange files, read line by line, in whatever coding they are."""

from __future__ import annotations

import codecs
import io
import re
from collections.abc import Iterator

from quillspan.sources.carving import COMMON_HAN
from quillspan.sources.compound import object_units

#: Codings of a drawing's stated code page, and of \M+n escapes. Fixed values.
CODE_PAGES = {"ANSI_936": "gb18030", "GB2312": "gb18030", "ANSI_950": "big5", "ANSI_932": "cp932", "ANSI_949": "cp949", "ANSI_1250": "cp1250", "ANSI_1251": "cp1251", "ANSI_1252": "cp1252", "ANSI_1253": "cp1253", "ANSI_1254": "cp1254"}
ESCAPED = {"1": "cp932", "2": "big5", "3": "cp949", "4": "johab", "5": "gbk"}
#: Version from which drawings are in UTF-8; frequent Chinese characters that must appear for texts without any to be read as GB18030; least Chinese characters of a file, and the share that must be found, without a warning. Fixed values.
UTF8_SINCE, LEAST_COMMON, LOSS_LEAST, LOSS_SHARE = 1021, 20, 200, 0.05
TEXT_KINDS = ("TEXT", "ATTRIB", "ATTDEF", "MTEXT", "MULTILEADER")
STEP = 1 << 20


def _decoded(data: bytes, coding: str, errors: str = "replace") -> Iterator[str]:
    """A text by steps of bounded size."""
    step = codecs.getincrementaldecoder(coding)(errors)
    for at in range(0, len(data), STEP):
        yield step.decode(data[at : at + STEP], at + STEP >= len(data))


def _han(data: bytes, coding: str) -> int:
    return sum("㐀" <= c <= "鿿" for part in _decoded(data, coding) for c in part if c > "㏿")


def chosen_coding(data: bytes) -> str:
    """GB18030 if read so the bytes hold more than twice the Chinese characters that they hold as UTF-8."""
    return "GB18030" if _han(data, "gb18030") > 2 * _han(data, "utf-8") else "UTF-8"


def _is_utf8(data: bytes) -> bool:
    try:
        for _ in _decoded(data, "utf-8", "strict"):
            pass
    except UnicodeDecodeError:
        return False
    return True


def pairs(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Codes and values in turn, without holding the lines."""
    lines = io.BytesIO(data)
    for code in lines:
        yield code.strip().decode("latin-1"), lines.readline().rstrip(b"\r\n")


def texts(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """Kind, layer and raw text of each record that shows a text and isn't hidden itself, by the file's order; records of layers, blobs of objects in hexadecimal."""
    kind, layer, parts, hidden, flags, color, plot = "", b"", [], False, 0, 1, 1
    for code, value in pairs(data):
        if code == "0":
            if kind in TEXT_KINDS and parts and not hidden:
                yield kind, layer, b"".join(parts)
            elif kind == "LAYER":
                yield "OFF" if flags & 1 or color < 0 or not plot else "ON", layer, b""
            elif kind == "OLE2FRAME" and not hidden:
                yield kind, layer, b"".join(parts)
            kind, layer, parts, hidden, flags, color, plot = value.strip().decode("latin-1").upper(), b"", [], False, 0, 1, 1
        elif code == "8" or code == "2" and kind == "LAYER":
            layer = value
        elif code in ("1", "3", "304") and kind in TEXT_KINDS or kind == "OLE2FRAME" and code in ("310", "311", "312", "313", "314", "315", "316", "317", "318", "319"):
            parts.append(value)
        elif code == "60":
            hidden = value.strip() == b"1"
        elif code in ("70", "62", "290") and kind == "LAYER" and re.fullmatch(rb"\s*-?\d+\s*", value):
            flags, color, plot = (int(value) if code == c else old for c, old in (("70", flags), ("62", color), ("290", plot)))
    if kind in TEXT_KINDS and parts and not hidden:
        yield kind, layer, b"".join(parts)


def layout_names(data: bytes) -> list[str]:
    """Names of a drawing's paper layouts, each once whatever its case."""
    out, kind, part = {}, "", b""
    for code, value in pairs(data):
        if code == "0":
            kind, part = value.strip().decode("latin-1").upper(), b""
        elif code == "100":
            part = value.strip()
        elif code == "1" and kind == "LAYOUT" and part == b"AcDbLayout":
            name = value.strip().decode("utf-8", "replace")
            if name.lower() != "model":
                out.setdefault(name.lower(), name)
    return list(out.values())


def drawing_coding(data: bytes) -> str:
    """The coding of a drawing's texts: UTF-8 if its version says so or all bytes are, else that of its code page, else by vote. If its texts then hold no Chinese character, but many frequent ones as GB18030, it is that."""
    version = re.search(rb"\$ACADVER\s+1\s+AC(\d+)", data[:STEP])
    if version and int(version[1]) >= UTF8_SINCE or _is_utf8(data):
        return "utf-8"
    page = re.search(rb"\$DWGCODEPAGE\s+3\s+(\w+)", data[:STEP])
    coding = CODE_PAGES.get(page[1].decode().upper()) if page else None
    if coding is None:
        return chosen_coding(data).lower()
    shown = lambda x: (c for kind, _, raw in texts(data) if kind in TEXT_KINDS for c in raw.decode(x, "replace"))
    if not any("一" <= c <= "鿿" for c in shown(coding)) and sum(c in COMMON_HAN for c in shown("gb18030")) >= LEAST_COMMON:
        return "gb18030"
    return coding


def recovered(text: str) -> str | None:
    """What a text without Chinese characters reads as if its bytes are GB18030, if that holds many frequent ones; None otherwise."""
    if any("一" <= c <= "鿿" for c in text):
        return None
    read = text.encode("latin-1", "replace").decode("gb18030", "replace")
    return read if sum(c in COMMON_HAN for c in read) >= LEAST_COMMON else None


def plain_mtext(s: str) -> str:
    """A record's text without formatting codes, with escapes as the characters they stand for."""
    s = re.sub(r"\\[Uu]\+([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), s)
    s = re.sub(r"\\[Mm]\+([1-5])([0-9A-Fa-f]{4})", lambda m: bytes.fromhex(m[2]).decode(ESCAPED[m[1]], "replace"), s)
    s = re.sub(r"\\[Pp]", "\n", s).replace("\\~", " ")
    return re.sub(r"[{}\\]", "", re.sub(r"\\[A-Za-z][^;{}]*;", "", s))


def dxf_units(data: bytes) -> Iterator[dict]:
    """Texts of a drawing's records on visible layers, in order and as often as they occur, then those of embedded objects. A warning if most of the Chinese characters in the file are lost.

    The file is read line by line, so that no more than its bytes and one record is held.
    """
    coding, off, found = drawing_coding(data), set(), 0
    for kind, layer, raw in texts(data):
        if kind == "OFF":
            off.add(layer)
        elif kind in TEXT_KINDS and layer not in off:
            for line in plain_mtext(raw.decode(coding, "replace")).split("\n"):
                if line.strip():
                    found += sum("一" <= c <= "鿿" for c in line)
                    yield {"kind": kind.lower(), "text": line.strip()}
    for kind, layer, raw in texts(data):
        if kind == "OFF":
            off.add(layer)
        elif kind == "OLE2FRAME" and layer not in off:
            try:
                yield from ({**unit, "kind": "object"} for unit in object_units(bytes.fromhex(raw.replace(b" ", b"").decode("latin-1"))))
            except Exception as e:  # a broken object must not end the drawing
                yield {"kind": "warning", "text": "", "error": f"object: {type(e).__name__}: {e}"[:200]}
    held = _han(data, coding)
    if held > LOSS_LEAST and found < LOSS_SHARE * held:
        yield {"kind": "warning", "text": "", "error": f"{held - found} of {held} Chinese characters are not in texts"}
