"""Text units of files: plain text, PDF, Office packages, drawings, and archives of them."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.layers import is_poisoned, sanitize_paragraph
from quillspan.functions.text import PLACEHOLDERS
from quillspan.operators.units import small_batches
from quillspan.sources.carving import carved_units
from quillspan.sources.compound import doc_units, ppt_units, xls_units
from quillspan.sources.drawing import dxf_units
from quillspan.sources.packed import rar_members, seven_members
from quillspan.sources.pdf import pdf_units

#: Archives inside archives are opened down to this depth, and members up to this size.
MOST_DEPTH, MOST_BYTES = 5, 256 << 20
UNIT_SCHEMA = "path string, member string, depth int, ok boolean, error string, seq int, kind string, sheet string, row int, col int, hidden boolean, text string"
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
UNIT_FIELDS = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in UNIT_SCHEMA.split(", ")])


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _own_text(node, leaf: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _name(x.tag) == leaf)


def _value(node, key: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _name(k) == key), None)


def text_units(data: bytes) -> Iterator[dict]:
    """Lines that aren't blank, as UTF-8 with replacements."""
    for line in data.decode("utf-8", "replace").splitlines():
        if line.strip():
            yield {"kind": "p", "text": line.strip()}


def _hidden_run(run) -> bool:
    return any(_name(x.tag) in ("vanish", "webHidden") and _value(x, "val") not in ("0", "false") for p in run if _name(p.tag) == "rPr" for x in p)


def _paragraph(node) -> str:
    """A paragraph's visible text. Text boxes are met again as paragraphs of their own, and their older copies are left out."""
    out = []

    def walk(x):
        for y in x:
            kind = _name(y.tag)
            if kind in ("txbxContent", "Fallback", "pict", "del") or kind == "r" and _hidden_run(y):
                continue
            if kind == "t":
                out.append(y.text or "")
            elif kind in ("tab", "br"):
                out.append(" ")
            walk(y)

    walk(node)
    return "".join(out)


def _without_older_copies(node) -> Iterator:
    """A node and what is in it, but for the copies that are stored for older readers."""
    yield node
    for x in node:
        if _name(x.tag) != "Fallback":
            yield from _without_older_copies(x)


def docx_units(data: bytes) -> Iterator[dict]:
    """Paragraphs and table cells of the body, then of foot- and endnotes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml"):
            if part not in z.namelist():
                continue
            root = ElementTree.fromstring(z.read(part))
            cells = {}
            for table in (x for x in root.iter() if _name(x.tag) == "tbl"):
                for r, row in enumerate(x for x in table if _name(x.tag) == "tr"):
                    for c, cell in enumerate(x for x in row if _name(x.tag) == "tc"):
                        cells |= {id(p): (r, c) for p in cell.iter() if _name(p.tag) == "p"}
            for p in (x for x in _without_older_copies(root) if _name(x.tag) == "p"):
                text = _paragraph(p).strip()
                if text:
                    row, col = cells.get(id(p), (None, None))
                    yield {"kind": "cell" if id(p) in cells else "p", "row": row, "col": col, "text": text}


def _column(ref: str) -> int:
    out = 0
    for c in re.match("[A-Z]*", ref)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def dated(value: str) -> str:
    try:
        v = float(value)
    except ValueError:
        return value
    if 20000 < v < 60000:
        return (pd.Timestamp("1899-12-30") + pd.Timedelta(days=int(v))).strftime("%m月%d日")
    return str(int(v)) if v == int(v) else value


def xlsx_units(data: bytes) -> Iterator[dict]:
    """Cells in order, with their sheet and whether it is hidden; shared, inline and formula strings, and numbers that stand for days as dates."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_own_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {x.attrib["Id"]: x.attrib["Target"] for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _name(x.tag) == "sheet"):
            target = targets.get(_value(sheet, "id") or "", f"worksheets/sheet{k + 1}.xml").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            if path not in names:
                continue
            for cell in (x for x in ElementTree.fromstring(z.read(path)).iter() if _name(x.tag) == "c"):
                kind, ref = cell.attrib.get("t", "n"), cell.attrib.get("r", "A1")
                value = next((x.text or "" for x in cell if _name(x.tag) == "v"), "")
                text = _own_text(cell) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value if kind in ("str", "b", "e") else dated(value)
                if text.strip():
                    yield {"kind": "cell", "sheet": sheet.attrib.get("name"), "hidden": sheet.attrib.get("state", "visible") != "visible", "row": int(re.search(r"\d+$", ref)[0]) - 1, "col": _column(ref), "text": text.strip()}


def active_sheet(data: bytes) -> str | None:
    """The name of the sheet that a workbook shows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("xl/workbook.xml"))
    shown = next((int(v) for x in root.iter() if (v := x.attrib.get("activeTab", "")).isdigit()), 0)
    names = [x.attrib.get("name") for x in root.iter() if _name(x.tag) == "sheet"]
    return names[shown] if shown < len(names) else None


def pptx_units(data: bytes) -> Iterator[dict]:
    """Paragraphs of the slides by number, then of their notes, which count as hidden."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for folder, hidden in (("slides/slide", False), ("notesSlides/notesSlide", True)):
            found = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(rf"ppt/{folder}(\d+)\.xml", n)))
            for number, name in found:
                for p in (x for x in ElementTree.fromstring(z.read(name)).iter() if _name(x.tag) == "p"):
                    text = _own_text(p).strip()
                    if text and not (len(text) <= 15 and text.lower() in PLACEHOLDERS):
                        yield {"kind": "note" if hidden else "p", "sheet": str(number), "hidden": hidden, "text": text}


def app_numbers(data: bytes) -> dict[str, int]:
    """Whole numbers that an Office package states of itself, such as its pages."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "docProps/app.xml" not in z.namelist():
            return {}
        return {_name(x.tag): int(x.text) for x in ElementTree.fromstring(z.read("docProps/app.xml")).iter() if re.fullmatch(r"\d{1,18}", (x.text or "").strip())}


def titled(extract: Callable[[bytes], Iterator[dict]]) -> Callable[[bytes], Iterator[dict]]:
    """Units of an Office package, then the title that its properties state, which counts as hidden."""

    def each(data: bytes) -> Iterator[dict]:
        yield from extract(data)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if "docProps/core.xml" in z.namelist():
                stated = _own_text(ElementTree.fromstring(z.read("docProps/core.xml")), "title").strip()
                if stated:
                    yield {"kind": "title", "hidden": True, "text": stated}

    return each


#: What reads a file, by its extension. More can be put in.
EXTRACTORS = {"txt": text_units, "md": text_units, "csv": text_units, "docx": titled(docx_units), "xlsx": titled(xlsx_units), "xlsm": titled(xlsx_units), "pptx": titled(pptx_units), "doc": doc_units, "xls": xls_units, "ppt": ppt_units, "dxf": dxf_units, "pdf": pdf_units, "dwg": carved_units}


def _repaired(info: zipfile.ZipInfo) -> str:
    """A member's name; one without the UTF-8 flag may be GBK or UTF-8 that was read as code page 437."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.filename.encode("cp437", "replace")
    for coding in ("utf-8", "gbk"):
        try:
            return raw.decode(coding)
        except UnicodeDecodeError:
            pass
    return info.filename


def _unsafe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or bool(re.match("[A-Za-z]:", name))


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes | str]]:
    """Names and bytes of an archive's files, or why one isn't read: it is too large, packed in a way that isn't known, or would leave the archive's folder."""
    for inner, body in _members(name, data):
        yield inner, "leaves the archive's folder" if _unsafe(inner) else body


def _members(name: str, data: bytes) -> Iterator[tuple[str, bytes | str]]:
    low, large = name.lower(), f"larger than {MOST_BYTES} bytes"
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield _repaired(info), large if info.file_size > MOST_BYTES else "encrypted" if info.flag_bits & 1 else z.read(info)
    elif low.endswith(".7z"):
        yield from seven_members(data, MOST_BYTES)
    elif low.endswith(".rar"):
        yield from rar_members(data, MOST_BYTES)
    elif re.search(r"\.(tar|tar\.gz|tgz|tar\.bz2|tbz2|tar\.xz|txz)$", low):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile():
                    yield info.name, t.extractfile(info).read() if info.size <= MOST_BYTES else large
    else:
        read = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[low.rpartition(".")[2]]
        with read(io.BytesIO(data)) as f:
            body = f.read(MOST_BYTES + 1)
            yield name.rpartition(".")[0].rpartition("/")[2], body if len(body) <= MOST_BYTES else large


def is_archive(name: str) -> bool:
    return bool(re.search(r"\.(zip|7z|rar|tar|gz|tgz|bz2|tbz2|xz|txz)$", name.lower()))


def file_units(path: str, data: bytes, member: str = "", depth: int = 0) -> Iterator[dict]:
    """Units of one file, or of all files in an archive. What can't be read gives one row with the reason."""
    name = member or path
    base = {"path": path, "member": member, "depth": depth, "ok": True}
    try:
        if is_archive(name):
            if depth >= MOST_DEPTH:
                raise ValueError("nested too deeply")
            for inner, body in members(name, data):
                within = f"{member}/{inner}".lstrip("/")
                if isinstance(body, str):
                    yield base | {"member": within, "depth": depth + 1, "ok": False, "error": f"ValueError: {body}"}
                else:
                    yield from file_units(path, body, within, depth + 1)
            return
        extract = EXTRACTORS.get(name.lower().rpartition(".")[2])
        if extract is None:
            raise ValueError("unsupported format")
        for seq, unit in enumerate(extract(data)):
            yield base | {"seq": seq} | unit
    except Exception as e:  # a broken file must not end the batch
        yield base | {"ok": False, "error": f"{type(e).__name__}: {e}"[:200]}


def units_of_files(files: DataFrame) -> DataFrame:
    """Text units of a table with path and content, such as the binaryFile source gives; one of kind none for a file without any. Spark itself passes over files of no bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(file_units(path, content.as_py() or b"")) or [{"path": path, "member": "", "depth": 0, "ok": True, "kind": "none", "text": ""}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in UNIT_FIELDS], schema=UNIT_FIELDS)

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(each, UNIT_SCHEMA)


def clean_layers(units: DataFrame) -> DataFrame:
    """Units without the mojibake of text layers of PDF files, and those layers' other units without stray East-Asian characters and leader dots. Texts that nothing is left of go."""
    of_pdf = F.lower(F.when(F.col("member") != "", F.col("member")).otherwise(F.col("path"))).endswith(".pdf") & (F.col("kind") == "p")
    kept = units.where(~F.coalesce(of_pdf & is_poisoned(F.col("text")), F.lit(False)))
    return kept.withColumn("text", F.when(of_pdf, sanitize_paragraph(F.col("text"))).otherwise(F.col("text"))).where("not (kind = 'p' and text = '')")


def collected_inputs(spark: SparkSession, inputs: list[str], recursive: bool = True) -> list[str]:
    """Folders and files that some paths and patterns name, each once, without what lies in another of these folders. Only paths reach the driver."""
    conf, found = spark._jsc.hadoopConfiguration(), {}
    for given in inputs:
        path = spark._jvm.org.apache.hadoop.fs.Path(given)
        for status in path.getFileSystem(conf).globStatus(path) or ():
            found[status.getPath().toString()] = status.isDirectory()
    folders = {p for p, is_folder in found.items() if is_folder}
    within = lambda p: [q for q in (p[:k] for k in range(len(p)) if p[k] == "/") if q in folders]
    held = lambda p, is_folder: within(p) if recursive else [q for q in within(p) if not is_folder and q == p.rpartition("/")[0]]
    return sorted(p for p, is_folder in found.items() if not held(p, is_folder))


def read_units(spark: SparkSession, inputs: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Text units of all files that some paths and patterns name, or below folders, each file once. Contents are read where they are extracted, without a shuffle. ValueError if nothing is found."""
    paths = collected_inputs(spark, [inputs] if isinstance(inputs, str) else inputs, recursive)
    if not paths:
        raise ValueError(f"no files: {inputs}")
    return units_of_files(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(paths))
