"""Sources, alignment and the journal on small files made here."""

import base64
import bz2
import gzip
import io
import itertools
import json
import lzma
import random
import struct
import tarfile
import zlib

import pytest

from quillspan.__main__ import file_totals
from quillspan.operators import diff, sequences
from quillspan.plans.drawings import chosen_coding, frames_of_lines, unseen_fragments
from quillspan.plans.grouping import contained_in, sheet_numbers
from quillspan.plans.files import built_compound, built_doc, built_file, built_ppt, near_line_dedup, zipped
from quillspan.sources import carving, compound, drawing, office, pdf
from quillspan.sources.office import clean_layers, collected_inputs, file_units, read_units
from quillspan.streaming import journal

WORD = "<d xmlns:w='w'><w:body>{}</w:body></d>"


def texts(name, data):
    return [u["text"] for u in file_units(name, data) if u["ok"]]


def test_docx_leaves_out_what_is_hidden():
    run = "<w:r><w:t>{}</w:t></w:r>"
    body = "<w:p>" + run.format("shown ") + "<w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r>" + run.format("too") + "<w:r><w:pict><w:t>copy</w:t></w:pict></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc><w:p>" + run.format("a1") + "</w:p></w:tc><w:tc><w:p>" + run.format("b1") + "</w:p></w:tc></w:tr></w:tbl>"
    data = zipped({"word/document.xml": WORD.format(body + table), "word/footnotes.xml": WORD.format("<w:p>" + run.format("note") + "</w:p>"), "word/header1.xml": WORD.format("<w:p>" + run.format("head") + "</w:p>")})
    units = list(file_units("x.docx", data))
    assert [u["text"] for u in units] == ["shown too", "a1", "b1", "note"]
    assert [(u.get("row"), u.get("col")) for u in units[1:3]] == [(0, 0), (0, 1)]


def test_xlsx_strings_dates_and_hidden_sheets():
    book = "<w xmlns:r='r'><sheets><sheet name='A' r:id='r1'/><sheet name='H' state='hidden' r:id='r2'/></sheets></w>"
    rels = "<R><Relationship Id='r1' Target='worksheets/sheet1.xml'/><Relationship Id='r2' Target='worksheets/sheet2.xml'/></R>"
    one = "<s><c r='A1' t='s'><v>0</v></c><c r='B1'><v>45000</v></c><c r='C1'/><c r='AA2'><v>7.0</v></c></s>"
    data = zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": "<s><si><t>sha</t><t>red</t></si></s>", "xl/worksheets/sheet1.xml": one, "xl/worksheets/sheet2.xml": "<s><c r='A1' t='inlineStr'><is><t>x</t></is></c></s>"})
    units = list(file_units("x.xlsx", data))
    assert [(u["text"], u["hidden"], u["col"]) for u in units] == [("shared", False, 0), ("03月15日", False, 1), ("7", False, 26), ("x", True, 0)]


def test_pptx_notes_and_placeholders():
    slide = "<s xmlns:a='a'>{}</s>"
    p = "<a:p><a:t>{}</a:t></a:p>"
    data = zipped({"ppt/slides/slide10.xml": slide.format(p.format("ten")), "ppt/slides/slide2.xml": slide.format(p.format(" Footer ") + p.format("two")), "ppt/notesSlides/notesSlide2.xml": slide.format(p.format("note"))})
    assert texts("x.pptx", data) == ["two", "ten", "note"]


def test_dxf_codes():
    data = "0\nMTEXT\n1\n{\\fSimSun|b0;A\\PB}\\U+4E2D\n0\nLINE\n1\nnot text\n0\nTEXT\n1\nA\n0\nEOF\n".encode()
    assert texts("x.dxf", data) == ["A", "B中", "A"]


def test_archives_inside_archives():
    inner = built_file("txt", ["deep"])
    for _ in range(6):
        inner = zipped({"n.zip": inner}) if inner[:2] == b"PK" else zipped({"n.txt": inner.decode()})
    assert [u["error"] for u in file_units("x.zip", inner)] == ["ValueError: nested too deeply"]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, body in (("a.txt", b"one\n\ntwo"), ("../b.txt", b"out"), ("c.rar", b"?")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    units = list(file_units("x.tar.gz", out.getvalue()))
    assert [(u["member"], u["ok"]) for u in units] == [("a.txt", True), ("a.txt", True), ("../b.txt", False), ("c.rar", False)]
    assert [u["ok"] for u in file_units("x.docx", b"broken")] == [False]


def test_too_large_members_give_errors(monkeypatch):
    monkeypatch.setattr(office, "MOST_BYTES", 8)
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for name, size in (("big.txt", 9), ("a.txt", 8)):
            info = tarfile.TarInfo(name)
            info.size = size
            t.addfile(info, io.BytesIO(b"x" * size))
    for name, data in (("x.zip", zipped({"big.txt": "x" * 9, "a.txt": "x" * 8})), ("x.tar", tar.getvalue())):
        assert [(u["member"], u["ok"], u.get("error")) for u in file_units(name, data)] == [("big.txt", False, "ValueError: larger than 8 bytes"), ("a.txt", True, None)]
    for pack, ext in ((gzip, "gz"), (bz2, "bz2"), (lzma, "xz")):
        assert [(u["member"], u["ok"]) for size in (8, 9) for u in file_units(f"a.txt.{ext}", pack.compress(b"x" * size))] == [("a.txt", True), ("a.txt", False)]


def test_read_units(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_text("one\n two \n")
    (tmp_path / "d" / "b.docx").write_bytes(built_file("docx", ["three"]))
    assert sorted(r.text for r in read_units(spark, str(tmp_path)).collect()) == ["one", "three", "two"]


def test_alignment_of_a_text_with_itself_and_with_changes():
    same = ["a b c", "d", "a b c"]
    assert [t for t, *_ in diff.align(same, same)] == ["EQ"] * 3
    assert diff.volume("a b", "a b") == (0, 0)
    ops = diff.align(["first line here", "qqq www zzz", "the long middle line", "last"], ["first line here", "middle", "the lang middle lines", "new 123456"])
    assert ops[0] == ("EQ", 0, 0) and ("SUB_EQ", 2, 1) in ops and ("DEL", 1, None) in ops and ("INS", None, 3) in ops
    assert {i for _, i, _ in ops if i is not None} == {0, 1, 2, 3} and [j for *_, j in ops if j is not None] == [0, 1, 2, 3]
    assert diff.ratio("abcd", "abxd") == 0.75 and diff.ratio("", "a") == 0
    assert diff.volume("old word", "new word") == (3, 3)


def test_intervals_merge_once(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 6, 9), (1, 11, 12), (1, 1, 2)], "g int, s int, e int")
    once = sequences.merge_intervals(df, "g")
    assert sorted((r.s, r.e) for r in once.collect()) == [(0, 9), (11, 12)]
    assert sorted((r.s, r.e) for r in sequences.merge_intervals(once, "g").collect()) == [(0, 9), (11, 12)]
    assert [(r.gap_start, r.gap_stop) for r in sequences.gaps(once, "g").collect()] == [(9, 11)]


def test_journal_stream(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    rows = [{"type": "progress", "id": "a", "done": 1, "t": 1}, {"id": "a", "rawResultJson": "old", "done": 3, "t": 2}, {"id": "a", "rawResultJson": "new", "done": 2, "t": 3}, {"type": "batch_end", "t": 4}]
    (folder / "1.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + '{"id": "half')
    q = journal.latest_results(journal.read_journal(spark, str(folder))).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.id, r.rawResultJson, r.done) for r in spark.table("latest").collect()] == [("a", "new", 3)]


def test_pdf_pages_fonts_and_fields():
    data = built_file("pdf", ["héllo wörld", "中文 text", "\U0001f600 x"] + ["z"] * 40)
    units = list(file_units("x.pdf", data))
    assert [u["text"] for u in units[:3]] == ["héllo wörld", "中文 text", "\U0001f600 x"]
    assert {u["sheet"] for u in units} == {"1", "2"} and pdf.count_pages(data) == 2
    more = data + b"90 0 obj\n<</FT/Tx/V(Some value)/DV <FEFF4E2D>>>\nendobj\n91 0 obj\n<</Title(A \\(b\\))>>\nendobj\n"
    assert pdf.form_values(more) == ["Some value", "中"] and pdf.title(more) == "A (b)"
    assert pdf.pdf_pages(built_file("pdf", [])) == [""] and [u["kind"] for u in file_units("x.pdf", built_file("pdf", []))] == ["image"]
    assert [u["error"] for u in file_units("x.pdf", b"no")] == ["ValueError: not a PDF"]


def test_pdf_operators_and_codings():
    assert pdf.decoded_page(b"BT (A\\050b\\)) Tj [(x) -300 (y) 20 (z)] TJ T* (next (in) line) Tj ET", {}) == "A(b)x yz\nnext (in) line"
    text = "这是一个中文的测试文本"
    assert pdf.decoded_page(b"BT (" + text.encode("gbk").replace(b"\\", b"\\\\") + b") Tj ET", {}) == text
    assert pdf.decoded_page(b"BT (caf\xe9) Tj ET", {}) == "café"
    head = b"5 0 1 6 "
    packed = b"%PDF-1.5\n2 0 obj\n<</Type/ObjStm/N 1/First 4>>stream\n7 0 <</Type/Page/Contents 3 0 R>>\nendstream\nendobj\n3 0 obj\n<<>>stream\nBT (in) Tj ET\nendstream\nendobj\n" + head
    assert pdf.pdf_pages(packed) == ["in"]


def test_carving():
    text = "这是一个中文的测试文本"
    assert carving.gbk_runs(b"\0\1\2" * 5 + text.encode("gbk") + bytes(9)) == [text]
    assert carving.utf16_runs(bytes(4) + "中文字符串ab".encode("utf-16-le") + bytes(4)) == ["中文字符串ab"]
    assert carving.latin_runs(b"\0\1Pump station\0zx12\0") == ["Pump station"]
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\0IHDR1234" + b"\0\0\0\0IEND1234"
    assert carving.carved_images(b"??" + png + b"\xff\xd8\xff..\xff\xd9") == [("png", 2, len(png)), ("jpg", 2 + len(png), 7)]
    assert carving.carved_images(png[:-3]) == []
    assert carving.media_parts(zipped({"word/media/b.x": "GIF89a", "word/media/a.x": "?", "word/document.xml": "<d/>"})) == [("word/media/a.x", None, 1), ("word/media/b.x", "gif", 6)]


def test_order_and_differences():
    ops = [("EQ", 0, 0), ("INS", None, 1), ("DEL", 1, None), ("REP", 2, 2)]
    assert diff.in_document_order(ops[::-1]) == ops
    assert diff.fused_opcodes(["a", "b"], ["a", "c"]) == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2)]
    for a, b in (("old word here", "new word"), ("", "x"), ("中文字", "中字"), ("w " * 3000 + "a", "w " * 2500 + "b " + "w " * 500)):
        runs = diff.diff_runs(a, b)
        assert "".join(x for _, x, _ in runs) == a and "".join(y for *_, y in runs) == b
        assert all(x == y for same, x, y in runs if same)
    assert diff.row_runs(["a", "b"], ["a"]) == [(0, True, "a", "a"), (1, False, "b", "")]
    body = diff.tracked_paragraph(diff.diff_runs("a <x>", "a y\x01"), "me", "2020-01-01T00:00:00Z", 1)
    assert '<w:delText xml:space="preserve">&lt;x&gt;</w:delText>' in body and ">y</w:t>" in body and body.count("w:id=") == 2


def test_frames_of_lines(spark):
    rows = [(1, True, y, x, x + 400) for y in (0, 300) for x in (0, 1000)] + [(1, False, x, 0, 300) for x in (0, 400, 1000, 1400)]
    rows += [(1, False, 200, 0, 300), (2, True, 0, 0, 400), (2, True, 300, 0, 400), (2, False, 0, 0, 300)]
    got = frames_of_lines(spark.createDataFrame(rows, "file int, flat boolean, place int, s int, e int")).collect()
    assert sorted((r.file, r.x0, r.y0, r.x1, r.y1) for r in got) == [(1, 0, 0, 400, 300), (1, 1000, 0, 1400, 300)]


def test_fragments_and_codings():
    assert unseen_fragments("one two", ["two", "three", "th ree", "", "four"]) == ["three", "four"]
    assert chosen_coding("中文".encode("gb18030")) == "GB18030" and chosen_coding("中文".encode()) == chosen_coding(b"") == "UTF-8"


def test_totals_of_chosen_sheets_and_notes(spark, tmp_path):
    book = "<w><sheets><sheet name='A'/><sheet name='H' state='hidden'/><sheet name='B'/></sheets></w>"
    cell = "<s><c r='A1' t='inlineStr'><is><t>{}</t></is></c></s>"
    (tmp_path / "a.xlsx").write_bytes(zipped({"xl/workbook.xml": book} | {f"xl/worksheets/sheet{k}.xml": cell.format(x) for k, x in enumerate(("one", "hidden", "two words"), 1)}))
    slide = "<s xmlns:a='a'><a:p><a:t>{}</a:t></a:p></s>"
    (tmp_path / "b.pptx").write_bytes(zipped({"ppt/slides/slide1.xml": slide.format("three"), "ppt/notesSlides/notesSlide1.xml": slide.format("a b c")}))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"\n")
    units = read_units(spark, str(tmp_path))
    words = lambda *how: [r.words for r in file_totals(units, *how).orderBy("path").collect()]
    assert words() == [3, 1, 0, 0] and words("first") == [1, 1, 0, 0] and words("B", True) == [2, 4, 0, 0]
    assert [r.error is None for r in file_totals(units).orderBy("path").collect()] == [True, True, False, True]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(now[j], row[j + 1]))
        row = now
    return row[-1]


def test_common_places_are_longest_at_any_size():
    rng = random.Random(1)
    for n in [*range(12), 30, 63, 64, 65, 200, 700]:
        for letters in ("ab", "abcdefgh"):
            a, b = ([rng.choice(letters) for _ in range(rng.randint(n // 2, n))] for _ in range(2))
            got = diff.common_places(a, b)
            assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
            assert len(got) == longest_common(a, b)
    a = [f"w{rng.randrange(50)}" for _ in range(6000)]
    b = [x for x in a if rng.random() < 0.9]
    assert len(diff.common_places(a, b)) == len(b)


def test_document_order_keeps_most_matches():
    """By brute force over all sets of matches; deletions stand just before the match that follows them."""
    rng = random.Random(2)
    for _ in range(80):
        n = rng.randint(1, 6)
        right = rng.sample(range(n), n)
        ops = [("EQ", i, j) for i, j in enumerate(right)][: rng.randint(0, n)]
        ops += [("DEL", i, None) for i in range(len(ops), n)] + [("INS", None, j) for j in range(n) if j not in [o[2] for o in ops]]
        got = diff.in_document_order(ops)
        kept = [o for o in got if o[0] == "EQ"]
        most = max(k for k in range(n + 1) for c in itertools.combinations([o for o in ops if o[0] == "EQ"], k) if all(x[2] < y[2] for x, y in itertools.pairwise(c)))
        assert len(kept) == most and [o[1] for o in kept] == sorted(o[1] for o in kept)
        assert [o[2] for o in got if o[2] is not None] == sorted(o[2] for o in got if o[2] is not None)
        assert sorted(map(str, got)) == sorted(map(str, kept + [o for o in ops if o[0] != "EQ"]))
        for k, o in enumerate(got):
            if o[0] == "DEL":
                assert all(x[1] < o[1] for x in got[:k] if x[0] == "EQ") and all(x[1] > o[1] for x in got[k:] if x[0] == "EQ")


def biff(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def test_legacy_office():
    lines = ["中文 one", "two", "x" * 5000]
    assert texts("a.doc", built_doc(lines)) == lines and texts("a.ppt", built_ppt(lines)) == lines
    doc = built_doc(["a \x13 HYPERLINK x \x14shown\x15 b"])
    assert texts("a.doc", doc) == ["a shown b"]
    long = "wide中" * 30
    shared = struct.pack("<II", 3, 3) + struct.pack("<HB", 3, 0) + b"abc" + struct.pack("<HBH", 2, 9, 1) + "中x".encode("utf-16-le") + b"runs"
    shared += struct.pack("<HB", len(long), 1)
    sst = biff(0xFC, shared + long[:50].encode("utf-16-le")) + biff(0x3C, b"\x01" + long[50:].encode("utf-16-le"))
    sheets = [("A", 0, biff(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + biff(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + biff(0xFD, struct.pack("<HHHI", 1, 0, 0, 2)) + biff(0x203, struct.pack("<HHHd", 2, 0, 0, 45000.0)) + biff(0x27E, struct.pack("<HHHI", 2, 1, 0, 7 << 2 | 2)) + biff(0xBD, struct.pack("<HHHIHIH", 3, 0, 0, 150 << 2 | 3, 0, 8 << 2 | 2, 1)) + biff(0x06, struct.pack("<HHHB5xHHI", 4, 0, 0, 0, 0xFFFF, 0, 0)) + biff(0x207, struct.pack("<HB", 2, 0) + b"fx")), ("B", 1, biff(0x204, struct.pack("<HHHHB", 0, 0, 0, 1, 0) + b"h"))]
    begin = biff(0x809, bytes(16))
    size = len(begin + sst) + sum(4 + 8 + len(n) for n, *_ in sheets) + 4
    heads, bodies = b"", b""
    for name, state, cells in sheets:
        heads += biff(0x85, struct.pack("<IBBBB", size + len(bodies), state, 0, len(name), 0) + name.encode())
        bodies += begin + cells + biff(0x0A, b"")
    book = built_compound({"Workbook": begin + heads + sst + biff(0x0A, b"") + bodies})
    got = [(u["sheet"], u["hidden"], u["row"], u["col"], u["text"]) for u in file_units("a.xls", book)]
    assert got == [("A", False, 0, 0, "abc"), ("A", False, 0, 1, "中x"), ("A", False, 1, 0, long), ("A", False, 2, 0, "03月15日"), ("A", False, 2, 1, "7"), ("A", False, 3, 0, "1.5"), ("A", False, 3, 1, "8"), ("A", False, 4, 0, "fx"), ("B", True, 0, 0, "h")]
    assert [u["ok"] for u in file_units("a.doc", b"\xd0\xcf broken")] == [False]
    assert compound.streams(built_compound({"a": b"1", "b": bytes(9000)})) == {"a": b"1".ljust(4096, b"\0"), "b": bytes(9216)}


def drawing_of(*records, head=""):
    return (head + "".join("".join(f"{c}\n{v}\n" for c, v in r) for r in records)).encode("gbk") + b"0\nEOF\n"


def test_drawings_in_code_pages():
    han = "的一是在不了有和人这中大为上个国我以要他"
    text = lambda s, layer="L": (("0", "TEXT"), ("8", layer), ("1", s))
    shown = lambda data: texts("a.dxf", data)
    page = "9\n$DWGCODEPAGE\n3\n{}\n"
    assert shown(drawing_of(text(han))) == [han] and shown(drawing_of(text("中文"), head=page.format("ANSI_936"))) == ["中文"]
    assert shown(drawing_of(text(han), head=page.format("ANSI_1252"))) == [han]
    assert drawing.drawing_coding(drawing_of(text("é"), head=page.format("ANSI_1252"))) == "cp1252"
    layers = [(("0", "LAYER"), ("2", n), *more) for n, more in (("L", ()), ("F", (("70", "1"),)), ("O", (("62", "-7"),)), ("P", (("290", "0"),)))]
    assert shown(drawing_of(*layers, *[text(n, n) for n in "LFOPX"], (*text("gone"), ("60", "1")))) == ["L", "X"]
    assert shown(drawing_of(text("\\M+5D6D0x"))) == ["中x"]
    lost = list(file_units("a.dxf", drawing_of(*[(("0", "OTHER"), ("9", han))] * 20, text("x"))))
    assert [u["kind"] for u in lost] == ["text", "warning"] and "Chinese" in lost[1]["error"]
    assert drawing.recovered(han.encode("gb18030").decode("latin-1")) == han and drawing.recovered("é" * 30) is None


def test_objects_in_drawings():
    book = "<w><bookViews><workbookView activeTab='1'/></bookViews><sheets><sheet name='A'/><sheet name='B'/></sheets></w>"
    cell = "<s><c r='A1' t='inlineStr'><is><t>{}</t></is></c></s>"
    packed = zipped({"xl/workbook.xml": book} | {f"xl/worksheets/sheet{k}.xml": cell.format(x) for k, x in enumerate(("first", "active"), 1)})
    for blob, want in ((built_compound({"Package": packed}), "active"), (built_doc(["old words"]), "old words")):
        raw = (b"\0\0" + blob).hex()
        rows = [(("0", "OLE2FRAME"), ("8", "L"), *[("310", raw[i : i + 254]) for i in range(0, len(raw), 254)])]
        assert texts("a.dxf", drawing_of((("0", "TEXT"), ("1", "t")), *rows)) == ["t", want]
    broken = list(file_units("a.dxf", drawing_of((("0", "OLE2FRAME"), ("310", "D0CF11E0A1B11AE1")), (("0", "TEXT"), ("1", "t")))))
    assert [u["kind"] for u in broken] == ["text", "warning"] and broken[1]["ok"]


def test_inputs_are_collected_once(spark, tmp_path):
    for name in ("a/b.txt", "a/c/d.txt", "e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    root = f"file:{tmp_path}"
    assert collected_inputs(spark, [f"{tmp_path}/a", f"{tmp_path}/a/c", f"{tmp_path}/*/b.txt", f"{tmp_path}/e.txt", f"{tmp_path}/e*"]) == [f"{root}/a", f"{root}/e.txt"]
    assert collected_inputs(spark, [f"{tmp_path}/a", f"{tmp_path}/a/c", f"{tmp_path}/a/b.txt"], recursive=False) == [f"{root}/a", f"{root}/a/c"]
    assert sorted(r.text for r in read_units(spark, [str(tmp_path), f"{tmp_path}/e.txt"]).collect()) == ["a/b.txt", "a/c/d.txt", "e.txt"]
    with pytest.raises(ValueError):
        read_units(spark, f"{tmp_path}/none")


def test_layers_are_cleaned(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(built_file("pdf", ["(cid:1)(cid:2)(cid:3) mojibake", "a plain line of words with 中 in it・・・", "中文字数统的是在"]))
    (tmp_path / "b.txt").write_text("(cid:1)(cid:2)(cid:3) mojibake")
    got = sorted(r.text for r in clean_layers(read_units(spark, str(tmp_path))).collect())
    assert got == ["(cid:1)(cid:2)(cid:3) mojibake", "a plain line of words with  in it", "中文字数统的是在"]


def test_pdf_filters(monkeypatch):
    body = b"BT (hi there) Tj ET"
    wrap = lambda name, raw: pdf._inflated(b"<</Filter " + name + b">>", raw)
    assert wrap(b"/ASCII85Decode", base64.a85encode(body) + b"~>") == wrap(b"[/AHx /Fl]", zlib.compress(body).hex().encode() + b">") == wrap(b"/RL", bytes([len(body) - 1]) + body + b"\x80") == body
    assert wrap(b"/LZWDecode", bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B" and wrap(b"/DCTDecode", b"x") == b""
    monkeypatch.setattr(pdf, "MOST_INFLATED", 100)
    rows = list(file_units("a.pdf", built_file("pdf", ["x" * 200])))
    assert [r["ok"] for r in rows] == [False] and "more than 100 bytes" in rows[0]["error"]


def test_contained_blocks_by_equi_joins(spark):
    docs = ["the cat sat on the mat today", "concatenate all", "a bc d", "x the cat", ""]
    blocks = ["cat sat on the mat", "cat", "n al", "at sat on", "nate all", "e cat sa", "zz", "", "bc", "he ca", "the mat", " bc "]
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(blocks)), "item_id int, text string")
    out = contained_in(b, d)
    want = {k: min(i for i, t in enumerate(docs) if x in t) for k, x in enumerate(blocks) if x and any(x in t for t in docs)}
    assert {r.item_id: r.doc_id for r in out.collect()} == want
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_plans_without_single_tasks(spark):
    from quillspan.plans import catalog

    for name in ("i01_numeric_order", "g04_near_overlaps", "f07_same_rectangles", "j03_maximal_frames", "f05_same_objects", "g02_contained_blocks"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan, name


def test_numbers_over_parts(spark):
    rows = [(k, k % 3) for k in range(500)]
    got = sequences.numbered(spark.createDataFrame(rows, "k int, n int"), sequences.F.col("n").cast("bigint") * 1000 + sequences.F.col("k"), "place").collect()
    want = {k: p for p, (n, k) in enumerate(sorted((n, k) for k, n in rows), 1)}
    assert {r.k: r.place for r in got} == want
    assert sequences.numbered(spark.createDataFrame([], "k int"), sequences.F.col("k").cast("bigint"), "place").collect() == []


def test_near_lines_as_brute_force(spark):
    rng = random.Random(4)
    rows = [(d, k, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 7)))) for d in range(6) for k in range(25)]
    got = {(r.doc_id, r.pos) for r in near_line_dedup(spark.createDataFrame(rows, "doc_id bigint, pos int, line string"), "doc_id").collect()}
    want = set()
    for d in range(6):
        kept = []
        for _, k, line in (r for r in rows if r[0] == d):
            key = line.replace(" ", "")
            if key and not any(key in x or x in key for x in kept):
                kept.append(key)
                want.add((d, k))
    assert got == want


def test_sheets_of_title_blocks(spark):
    rows = [(1, 1, "A1 FRAME", "NO", "T03004"), (1, 2, "x", "NO", "0001"), (1, 3, "x", "图号", "03004"), (1, 4, "DETAIL 2", "DWGNO", "12001"), (1, 5, "x", "NO", "5555"), (1, 5, "x", "TITLE", ""), (1, 6, "frame", "BY", "7777"), (1, 7, "TB", "NO", "12"), (2, 1, "x", "NO", "1234")]
    got = {r.file: r.sheets for r in sheet_numbers(spark.createDataFrame(rows, "file int, insert int, block string, tag string, text string")).collect()}
    assert got == {1: 3, 2: 0}


def seven(files, coder, pack, encoded=False):
    """A 7z archive of one solid folder, by hand; its header packed too if encoded."""
    number = lambda n: bytes([n]) if n < 128 else bytes([0xC0 | n >> 16]) + (n & 0xFFFF).to_bytes(2, "little")
    body = b"".join(files.values())

    def info(raw, size, at, more=b""):
        return b"\x06" + number(at) + b"\x01\x09" + number(len(raw)) + b"\x00\x07\x0b\x01\x00\x01" + coder + b"\x0c" + number(size) + b"\x00" + more + b"\x00"

    raw = pack(body)
    subs = b"\x08\x0d" + number(len(files)) + b"\x09" + b"".join(number(len(x)) for x in [*files.values()][:-1]) + b"\x0a\x01" + bytes(4 * len(files)) + b"\x00"
    names = b"\x00" + "".join(n + "\0" for n in [*files, "folder"]).encode("utf-16-le")
    header = b"\x01\x04" + info(raw, len(body), 0, subs) + b"\x05" + number(len(files) + 1) + b"\x0e\x01" + bytes([0x80 >> len(files)]) + b"\x11" + number(len(names)) + names + b"\x00\x00"
    if encoded:
        small = pack(header)
        raw, header = raw + small, b"\x17" + info(small, len(header), len(raw))
    return b"7z\xbc\xaf\x27\x1c\0\4" + bytes(4) + struct.pack("<QQI", len(raw), len(header), 0) + raw + header


def test_packed_archives(monkeypatch):
    files = {"a.txt": b"one\n", "d/b.txt": b"two words\n" * 300, "../c.txt": b"never"}
    squeeze = lambda how: lambda b: lzma.compress(b, lzma.FORMAT_RAW, filters=[how])
    ways = [(b"\x01\x00", lambda b: b), (b"\x21\x21\x01\x18", squeeze({"id": lzma.FILTER_LZMA2, "dict_size": 1 << 24})), (b"\x23\x03\x01\x01\x05\x5d" + struct.pack("<I", 1 << 16), squeeze({"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16})), (b"\x03\x04\x02\x02", bz2.compress)]
    for (coder, pack), encoded in itertools.product(ways, (False, True)):
        rows = list(file_units("x.7z", seven(files, coder, pack, encoded)))
        assert [u["text"] for u in rows if u["ok"]] == ["one"] + ["two words"] * 300
        assert [(u["member"], u["error"]) for u in rows if not u["ok"]] == [("../c.txt", "ValueError: leaves the archive's folder")]
    assert "method 0f" in next(file_units("x.7z", seven(files, b"\x01\x0f", lambda b: b)))["error"]
    block = lambda kind, flags, rest, body=b"": struct.pack("<HBHH", 0, kind, flags, 7 + len(rest)) + rest + body
    member = lambda name, body, method: block(0x74, 0x8000, struct.pack("<IIBIIBBHI", len(body), len(body), 0, 0, 0, 20, method, len(name), 0) + name, body)
    four = b"Rar!\x1a\x07\x00" + block(0x73, 0, bytes(6)) + member(b"a.txt", b"stored", 0x30) + member(b"b.txt", b"??", 0x33) + block(0x7B, 0, b"")
    head = lambda body, kind, rest: bytes(4) + bytes([len(rest) + 2 + bool(body)]) + bytes([kind, 2 if body else 0]) + (bytes([len(body)]) if body else b"") + rest + body
    five = b"Rar!\x1a\x07\x01\x00" + head(b"", 1, b"\0") + b"".join(head(body, 2, bytes([0, len(body), 0, how << 7 & 0x7F | (0x80 if how else 0), *([how] if how else []), 0, 5]) + name) for name, body, how in ((b"a.txt", b"stored", 0), (b"b.txt", b"??", 3))) + head(b"", 5, b"\0")
    for data in (four, five):
        rows = list(file_units("x.rar", data))
        assert [(u["member"], u["ok"]) for u in rows] == [("a.txt", True), ("b.txt", False)] and rows[0]["text"] == "stored" and "compressed" in rows[1]["error"]
    monkeypatch.setattr(office, "MOST_BYTES", 100)
    assert {u["error"] for u in file_units("x.7z", seven(files, *ways[1])) if not u["member"].startswith("..")} == {"ValueError: larger than 100 bytes"}


def test_titles_of_files(spark, tmp_path):
    core = "<c xmlns:dc='d'><dc:title> Stated </dc:title></c>"
    (tmp_path / "a.docx").write_bytes(zipped({"word/document.xml": WORD.format("<w:p><w:r><w:t>body text</w:t></w:r></w:p>"), "docProps/core.xml": core}))
    (tmp_path / "b.txt").write_text("x" * 90 + "\nfirst short line\nmore")
    (tmp_path / "c.pdf").write_bytes(built_file("pdf", ["page line"]).replace(b"/Type/Catalog", b"/Title(From PDF)/Type/Catalog"))
    (tmp_path / "d.zip").write_bytes(zipped({"a.txt": "inside"}))
    rows = file_totals(read_units(spark, str(tmp_path))).orderBy("path").collect()
    assert [r.title for r in rows] == ["Stated", "first short line", "From PDF", None] and [r.words for r in rows] == [2, 5, 2, 1]
