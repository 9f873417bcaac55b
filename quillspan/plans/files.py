"""Queries without SQL: files built from the tables, alignment of pairs, a replayed journal and reports."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import diff as D
from quillspan.operators.units import count_units, lines, small_batches
from quillspan.plans.counting import KEY, LINES, line_key
from quillspan.plans.grouping import _pairs
from quillspan.plans.registry import Tables, query
from quillspan.sources.office import units_of_files


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _safe(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def built_pdf(pages: list[list[str]]) -> bytes:
    """A PDF with a page for each list of lines, compressed, in a font with a character map."""
    kids = " ".join(f"{5 + 2 * k} 0 R" for k in range(len(pages)))
    objects = ["<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Count {len(pages)}/Kids[{kids}]/Resources<</Font<</F1 3 0 R>>>>>>", "<</Type/Font/ToUnicode 4 0 R>>"]
    streams = [("", b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange")]
    for lines in pages:
        shown = "".join(f"0 -14 Td <{s.encode('utf-16-be').hex()}> Tj " for s in lines)
        streams.append(("/Filter/FlateDecode", zlib.compress(f"BT /F1 12 Tf {shown}ET".encode())))
    out = [b"%PDF-1.4\n", *(f"{k} 0 obj\n{x}\nendobj\n".encode() for k, x in enumerate(objects, 1))]
    for k, (how, body) in enumerate(streams):
        out.append(f"{4 + 2 * k} 0 obj\n<</Length {len(body)}{how}>>stream\n".encode() + body + b"\nendstream\nendobj\n")
    out += [f"{5 + 2 * k} 0 obj\n<</Type/Page/Parent 2 0 R/Contents {6 + 2 * k} 0 R>>\nendobj\n".encode() for k in range(len(pages))]
    return b"".join(out)


def built_compound(parts: dict[str, bytes]) -> bytes:
    """A compound file with some streams, each filled up to whole sectors of 512 bytes and to 4,096 bytes at least."""
    filled = {n: b.ljust(max(4096, -(-len(b) // 512) * 512), b"\0") for n, b in parts.items()}
    n_dir = -(-(1 + len(parts)) // 4)
    n_body = sum(len(b) // 512 for b in filled.values())
    n_fat = 1
    while n_fat * 128 < n_fat + n_dir + n_body:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("too large for a header's list of sectors")
    table = [0xFFFFFFFD] * n_fat + [*range(n_fat + 1, n_fat + n_dir), 0xFFFFFFFE]
    name = lambda s: s.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H", 2 * len(s) + 2)
    none, entries = 0xFFFFFFFF, []
    for k, (n, b) in enumerate(filled.items()):
        entries.append(name(n) + struct.pack("<BBIII36xII4x", 2, 1, none, k + 2 if k + 1 < len(filled) else none, none, len(table), len(b)))
        table += [*range(len(table) + 1, len(table) + len(b) // 512), 0xFFFFFFFE]
    root = name("Root Entry") + struct.pack("<BBIII36xII4x", 5, 1, none, none, 1 if entries else none, 0xFFFFFFFE, 0)
    header = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, n_fat, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    header += struct.pack("<109I", *range(n_fat), *[none] * (109 - n_fat))
    fat = struct.pack(f"<{n_fat * 128}I", *table, *[none] * (n_fat * 128 - len(table)))
    return header + fat + b"".join([root, *entries]).ljust(512 * n_dir, b"\0") + b"".join(filled.values())


def built_doc(lines: list[str]) -> bytes:
    """A legacy document of one piece."""
    text = "".join(f"{s}\r" for s in lines)
    raw = text.encode("utf-16-le")
    main = bytearray(1024)
    struct.pack_into("<H8xH", main, 0, 0xA5EC, 0x0200)
    plc = struct.pack("<IIHIH", 0, len(raw) // 2, 0, 1024, 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", main, 418, 0, len(clx))
    return built_compound({"WordDocument": bytes(main) + raw, "1Table": clx})


def built_ppt(lines: list[str]) -> bytes:
    """A legacy presentation with a slide for each line."""
    atom = lambda kind, body, version=0: struct.pack("<HHI", version, kind, len(body)) + body
    return built_compound({"PowerPoint Document": b"".join(atom(0x03EE, atom(0x0FA0, s.encode("utf-16-le")), 15) for s in lines)})


def built_file(ext: str, lines: list[str]) -> bytes:
    """A small file of a format that holds the lines."""
    if ext == "docx":
        return zipped({"word/document.xml": "<d xmlns:w='w'><w:body>" + "".join(f"<w:p><w:r><w:t>{_safe(s)}</w:t></w:r></w:p>" for s in lines) + "</w:body></d>"})
    if ext == "xlsx":
        return zipped({"xl/workbook.xml": "<w><sheets><sheet name='S'/></sheets></w>", "xl/worksheets/sheet1.xml": "<s>" + "".join(f"<c r='A{i}' t='inlineStr'><is><t>{_safe(s)}</t></is></c>" for i, s in enumerate(lines, 1)) + "</s>"})
    if ext == "pptx":
        return zipped({"ppt/slides/slide1.xml": "<s xmlns:a='a'>" + "".join(f"<a:p><a:r><a:t>{_safe(s)}</a:t></a:r></a:p>" for s in lines) + "</s>"})
    if ext == "pdf":
        return built_pdf([lines[i : i + 40] for i in range(0, max(len(lines), 1), 40)])
    if ext == "doc":
        return built_doc(lines)
    if ext == "ppt":
        return built_ppt(lines)
    if ext == "dxf":
        return "".join(f"0\nTEXT\n1\n{s}\n" for s in lines).encode() + b"0\nEOF\n"
    if ext == "zip":
        return zipped({"a.txt": "\n".join(lines), "../b.txt": "never"})
    return "\n".join(lines).encode()


def _files(t: Tables, ext: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [built_file(ext, [s.strip() for s in (x or "").split("\n") if s.strip()]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.{ext}" for i in b.column(0).to_pylist()]), pa.array(made, pa.binary())], ["path", "content"])

    small_batches(t.spark)
    return t.documents.select("doc_id", "text").mapInArrow(each, "path string, content binary")


def _counted(t: Tables, ext: str) -> DataFrame:
    """The metrics of the files' units: those of the documents' lines."""
    units = units_of_files(_files(t, ext)).where("ok and kind not in ('none', 'image')")
    return count_units(units.withColumn("doc_id", F.regexp_extract("path", r"^\d+", 0).cast("bigint")), ["doc_id"], "text")


#: The files hold the documents' lines, so that their metrics are those of the lines.
LINES_SQL = f"SELECT doc_id, {T.TOTALS_SQL} FROM (SELECT doc_id, {T.metrics_sql('line')} FROM {LINES}) GROUP BY 1"


@query(LINES_SQL)
def a13_docx(t: Tables) -> DataFrame:
    return _counted(t, "docx")


@query(LINES_SQL)
def a16_xlsx(t: Tables) -> DataFrame:
    return _counted(t, "xlsx")


@query(LINES_SQL)
def a19_doc(t: Tables) -> DataFrame:
    """Lines as paragraphs of legacy documents."""
    return _counted(t, "doc")


@query(LINES_SQL)
def o29_ppt(t: Tables) -> DataFrame:
    """Lines as slides of legacy presentations."""
    return _counted(t, "ppt")


@query(LINES_SQL)
def a18_pptx(t: Tables) -> DataFrame:
    return _counted(t, "pptx")


@query(LINES_SQL)
def a23_dxf(t: Tables) -> DataFrame:
    return _counted(t, "dxf")


@query(LINES_SQL)
def b03_zip(t: Tables) -> DataFrame:
    return _counted(t, "zip")


#: First bytes of formats, in hexadecimal.
MAGIC = {"zip": "504B0304", "rar": "52617221", "gz": "1F8B", "pdf": "25504446", "7z": "377ABCAF271C"}


@query("SELECT doc_id || '.zip' AS path, 'zip' AS kind FROM documents UNION ALL SELECT doc_id || '.txt', NULL FROM documents")
def a05_magic_bytes(t: Tables) -> DataFrame:
    files = _files(t, "zip").unionByName(_files(t, "txt"))
    head, kind = F.hex(F.substring("content", 1, 8)), F.lit(None).cast("string")
    for name, start in MAGIC.items():
        kind = F.when(head.startswith(start), name).otherwise(kind)
    return files.select("path", kind.alias("kind"))


@query()
def g03_aligned_pairs(t: Tables) -> DataFrame:
    left, right = _pairs(t)
    return D.align_pairs(left, right)


@query(f"SELECT CAST(grouping(source) AS TINYINT) AS total, '| ' || coalesce(source, '合计') || ' | ' || sum(fe) || ' | ' || sum(nc) || ' | ' || sum(chars) || ' | ' || sum(words) || ' |' AS line FROM (SELECT source, {T.metrics_sql('text')} FROM documents) GROUP BY ROLLUP (source)")
def l02_summary_report(t: Tables) -> DataFrame:
    """A merged report's table as Markdown lines, the total last."""
    per = t.documents.select("source", *T.metrics(F.col("text"))).rollup("source").agg(*T.totals(), F.grouping("source").alias("total"))
    cells = [F.coalesce("source", F.lit("合计")), *[F.col(m).cast("string") for m in T.TOTALS]]
    return per.select("total", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def resolved_title(html: Column) -> Column:
    """A page's title: what it states, else its first heading, else its first text."""
    part = lambda pattern: F.nullif(T.stripped(F.regexp_extract(html, pattern, 1)), F.lit(""))
    return F.coalesce(part("<title>([^<]*)<"), part("<h1[^>]*>([^<]*)<"), part(">([^<>]*[A-Za-z][^<>]*)<"))


def _title(pattern: str) -> str:
    return f"nullif({T.stripped_sql(f"regexp_extract(html, '{pattern}', 1)")}, '')"


@query(f"SELECT page_id, coalesce({_title('<title>([^<]*)<')}, {_title('<h1[^>]*>([^<]*)<')}, {_title('>([^<>]*[A-Za-z][^<>]*)<')}) AS title FROM pages")
def c22_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", resolved_title(F.col("html")).alias("title"))


def decode_escapes(c: Column) -> Column:
    r"""Text with \U+XXXX escapes as the characters they stand for."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\\[Uu]\+[0-9A-Fa-f]{4}"), F.lit(0)))
    return F.aggregate(found, c, lambda text, e: F.replace(text, e, F.decode(F.unhex(F.substring(e, 4, 4)), "UTF-16BE")))


@query("SELECT p_partkey, p_name || '中ß' || p_size || '中' AS plain FROM part")
def c23_cad_escapes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", decode_escapes(F.concat("p_name", F.lit(r"\U+4E2D\u+00DF"), "p_size", F.lit(r"\U+4e2d"))).alias("plain"))


def near_line_dedup(lines: DataFrame, by: str) -> DataFrame:
    """Lines of each group in order, without those whose key was met, or lies within a longer kept one or around a kept one."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        kept, lengths, joined = set(), set(), ""
        take = []
        for key in rows.sort_values("pos")["key"]:
            new = bool(key) and key not in joined
            if new:
                # either each kept key is looked for, or, where they are many, parts of the key by the lengths that occur
                parts = sum(len(key) - n + 1 for n in lengths if n < len(key))
                new = not (any(x in key for x in kept) if len(kept) <= parts else any(key[i : i + n] in kept for n in lengths if n < len(key) for i in range(len(key) - n + 1)))
            take.append(new)
            if new:
                kept.add(key)
                lengths.add(len(key))
                joined += key + "\n"
        return rows.sort_values("pos")[take].drop(columns=["key"])

    keyed = lines.withColumn("key", line_key(F.col("line")))
    return keyed.groupBy(by).applyInPandas(each, f"{by} bigint, pos int, line string")


@query()
def f03_near_lines(t: Tables) -> DataFrame:
    return near_line_dedup(lines(t.documents), "doc_id")


@query(f"SELECT doc_id, pos, line FROM {LINES} WHERE pos % 2 = 0 UNION ALL SELECT doc_id, min(pos), arg_min(line, pos) FROM {LINES} o WHERE pos % 2 = 1 AND NOT EXISTS (SELECT 1 FROM {LINES} p WHERE p.doc_id = o.doc_id AND p.pos % 2 = 0 AND regexp_replace(lower(p.line), '{KEY}', '', 'g') = regexp_replace(lower(o.line), '{KEY}', '', 'g')) GROUP BY doc_id, regexp_replace(lower(line), '{KEY}', '', 'g')")
def f04_merged_readings(t: Tables) -> DataFrame:
    """One reading's lines and those of a second one that it lacks, each once. Even and odd lines stand for the readings."""
    keyed = lines(t.documents).withColumn("key", line_key(F.col("line")))
    first, second = keyed.where("pos % 2 = 0"), keyed.where("pos % 2 = 1")
    more = second.join(first.select("doc_id", "key"), ["doc_id", "key"], "left_anti").groupBy("doc_id", "key").agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("pos"))
    return first.drop("key").unionByName(more.drop("key")).select("doc_id", "pos", "line")
