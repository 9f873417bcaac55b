"""Queries of counting: C rows, and the sources and totals that rest on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import units as U
from quillspan.plans.registry import Tables, query

LINES = U.LINES_SQL


@query(f"SELECT doc_id, {T.metrics_sql(T.HAN_SQL)} FROM documents")
def c01_count_unit(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *T.metrics(T.with_han(F.col("text"))))


@query(f"SELECT doc_id, {T.TOTALS_SQL} FROM (SELECT doc_id, {T.metrics_sql('line')} FROM {LINES}) GROUP BY 1")
def c02_count_items(t: Tables) -> DataFrame:
    return U.count_units(U.lines(t.documents), ["doc_id"], "line")


@query(f"SELECT doc_id, {T.TOTALS_SQL} FROM (SELECT doc_id, {T.metrics_sql('p')} FROM (SELECT doc_id, unnest(string_split_regex({T.HAN_SQL}, '\n[{T.WS}]*\n')) AS p FROM documents)) GROUP BY 1")
def c03_paragraph_metrics(t: Tables) -> DataFrame:
    return U.count_units(U.paragraphs(t.documents.withColumn("text", T.with_han(F.col("text")))), ["doc_id"], "text")


@query(f"SELECT conv_id, turn, role || CASE WHEN turn % 3 = 0 THEN '.PNG' ELSE '.Txt' END AS name, CASE WHEN turn % 3 = 0 THEN '.png' ELSE '.txt' END AS ext, turn % 3 = 0 AS image_ocr, {T.metrics_sql('text')} FROM conversations")
def c04_count_text(t: Tables) -> DataFrame:
    named = t.conversations.withColumn("name", F.concat("role", F.when(F.col("turn") % 3 == 0, ".PNG").otherwise(".Txt")))
    ext = F.lower(F.regexp_extract("name", r"\.[^.]*$", 0))
    return named.select("conv_id", "turn", "name", ext.alias("ext"), ext.isin(".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp", ".tif", ".tiff").alias("image_ocr"), *T.metrics(F.col("text")))


@query(f"SELECT doc_id, {T.count_sql('text', '[0-9]')} AS num FROM documents")
def c05_digit_chars(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.count_of(F.col("text"), "[0-9]").alias("num"))


DIGIT_WORD = r"^[\p{Nd}._/-]+$"
NUMBERED = "o_orderkey || ' no. ' || o_custkey || '-' || o_orderkey || ' - ' || o_orderpriority || ' 12.5/3 x1'"
NUM_WORDS = f"CAST(len(list_filter(regexp_extract_all(s, '{T.RUN}'), lambda w: regexp_matches(w, '{DIGIT_WORD}'))) AS BIGINT)"


def digit_words(c):
    """Runs of digits and . - _ / alone."""
    return F.size(F.filter(F.regexp_extract_all(c, F.lit(T.RUN), F.lit(0)), lambda w: w.rlike(DIGIT_WORD))).cast("bigint")


@query(f"SELECT o_orderkey, {NUM_WORDS} AS num_words FROM (SELECT *, {NUMBERED} AS s FROM orders)")
def c06_digit_words(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", digit_words(F.expr(NUMBERED)).alias("num_words"))


@query(f"SELECT o_orderkey, fe AS text_fe, greatest(0, nc - nw) AS text_nc, greatest(0, chars - nd) AS text_chars, fe + greatest(0, nc - nw) AS text_words, nw AS num_words, nd AS num_chars FROM (SELECT o_orderkey, {T.metrics_sql('s')}, {NUM_WORDS} AS nw, {T.count_sql('s', '[0-9]')} AS nd FROM (SELECT *, {NUMBERED} AS s FROM orders))")
def c07_text_number_split(t: Tables) -> DataFrame:
    s = F.col("s")
    m = t.orders.withColumn("s", F.expr(NUMBERED)).select("o_orderkey", *T.metrics(s), digit_words(s).alias("nw"), T.count_of(s, "[0-9]").alias("nd"))
    text_nc = F.greatest(F.lit(0), F.col("nc") - F.col("nw"))
    return m.select("o_orderkey", F.col("fe").alias("text_fe"), text_nc.alias("text_nc"), F.greatest(F.lit(0), F.col("chars") - F.col("nd")).alias("text_chars"), (F.col("fe") + text_nc).alias("text_words"), F.col("nw").alias("num_words"), F.col("nd").alias("num_chars"))


def is_code(c):
    """Neither an ideograph, kana or hangul nor a word of two Latin letters or more."""
    return ~c.rlike(f"[{T.DRAWING_CJK}]") & ~c.rlike(f"[{T.LATIN}]{{2,}}")


CODE_SQL = f"(NOT regexp_matches(line, '[{T.DRAWING_CJK}]') AND NOT regexp_matches(line, '[{T.LATIN}]{{2,}}'))"
#: Part names broken into lines of words, sizes and codes.
PART_LINES = "(SELECT p_partkey, unnest([p_name, p_brand, CAST(p_size AS VARCHAR), 'A-' || p_size, '- ' || p_partkey, p_type]) AS line FROM part)"


def _part_lines(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.array("p_name", "p_brand", F.col("p_size").cast("string"), F.concat(F.lit("A-"), "p_size"), F.concat(F.lit("- "), "p_partkey"), "p_type")).alias("line"))


@query(f"SELECT p_partkey, line, {CODE_SQL} AS is_code FROM {PART_LINES}")
def c08_code_items(t: Tables) -> DataFrame:
    return _part_lines(t).withColumn("is_code", is_code(F.col("line")))


@query(f"SELECT p_partkey, part, count(*) AS items, {T.TOTALS_SQL} FROM (SELECT p_partkey, CASE WHEN {CODE_SQL} THEN 'code' ELSE 'text' END AS part, {T.metrics_sql('line')} FROM {PART_LINES}) GROUP BY 1, 2")
def c09_text_code_parts(t: Tables) -> DataFrame:
    parts = _part_lines(t).select("p_partkey", F.when(is_code(F.col("line")), "code").otherwise("text").alias("part"), *T.metrics(F.col("line")))
    return parts.groupBy("p_partkey", "part").agg(F.count("*").alias("items"), *T.totals())


@query(f"SELECT doc_id, {T.chars_sql('text')} AS chars FROM documents")
def c10_text_chars(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.chars(F.col("text")).alias("chars"))


def cell_text(v):
    """A number as a cell shows it: whole numbers between 20000 and 60000 as month and day, others without a fraction if they have none."""
    whole = F.floor(v)
    dated = (v > 20000) & (v < 60000)
    return F.when(dated, F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), whole.cast("int")), "MM'月'dd'日'")).when(v == whole, whole.cast("string")).otherwise(F.format_string("%.2f", v))


CELL_SQL = "CASE WHEN v > 20000 AND v < 60000 THEN strftime(DATE '1899-12-30' + CAST(floor(v) AS INTEGER), '%m月%d日') WHEN v = floor(v) THEN CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', v) END"


@query(f"SELECT l_orderkey, l_linenumber, {CELL_SQL} AS cell, {CELL_SQL.replace('v ', 'l_quantity ').replace('(v)', '(l_quantity)').replace(', v)', ', l_quantity)')} AS quantity FROM (SELECT *, round(l_extendedprice, 2) AS v FROM lineitem)")
def c11_cell_text(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", cell_text(F.round("l_extendedprice", 2)).alias("cell"), cell_text(F.col("l_quantity")).alias("quantity"))


@query(f"SELECT doc_id, {T.pages_sql(T.chars_sql('text'))} AS pages FROM documents")
def c12_estimate_pages(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.pages_of(T.chars(F.col("text"))).alias("pages"))


#: Layout mark-up as a word processor writes it, made from a document's number.
LAYOUT = "concat('<w:pgSz w:w=\"', 9000 + doc_id % 7 * 600, '\" w:h=\"', 12000 + doc_id % 5 * 1200, '\"/><w:pgMar w:top=\"', 700 + doc_id % 4 * 300, '\" w:right=\"900\" w:bottom=\"1000\" w:left=\"', 800 + doc_id % 3 * 500, '\"/>')"
SIZES = r'<w:pgSz\s+w:w="(\d+)"\s+w:h="(\d+)"'
MARGINS = r'<w:pgMar\s+w:top="(\d+)"\s+w:right="(\d+)"\s+w:bottom="(\d+)"\s+w:left="(\d+)"'


def pages_from_layout(xml, n_chars):
    """Pages of 10.5 point text with 1.5 lines of leading, from the page's size and margins; A4 where they aren't given."""
    got = lambda pattern, i, default: F.coalesce(F.nullif(F.regexp_extract(xml, pattern, i), F.lit("")).cast("double"), F.lit(float(default)))
    width = got(SIZES, 1, 11906) - got(MARGINS, 4, 1800) - got(MARGINS, 2, 1800)
    height = got(SIZES, 2, 16838) - got(MARGINS, 1, 1440) - got(MARGINS, 3, 1440)
    per_page = F.greatest(F.lit(800), F.least(F.lit(2500), F.floor(width / (10.5 * 20.0) * (height / (10.5 * 1.5 * 20.0))))).cast("bigint")
    return F.greatest(F.lit(1), F.floor((n_chars + per_page - 1) / per_page)).cast("bigint")


def _got(pattern: str, i: int, default: int) -> str:
    return f"coalesce(TRY_CAST(regexp_extract(xml, '{pattern}', {i}) AS DOUBLE), {default})"


@query(
    f"""SELECT doc_id, CAST(greatest(1, (n + p - 1) // p) AS BIGINT) AS pages FROM (SELECT doc_id, n, CAST(greatest(800, least(2500, floor(({_got(SIZES, 1, 11906)} - {_got(MARGINS, 4, 1800)} - {_got(MARGINS, 2, 1800)}) / (10.5::DOUBLE * 20) * (({_got(SIZES, 2, 16838)} - {_got(MARGINS, 1, 1440)} - {_got(MARGINS, 3, 1440)}) / (10.5::DOUBLE * 1.5 * 20))))) AS BIGINT) AS p
    FROM (SELECT doc_id, {T.chars_sql("text")} AS n, CASE WHEN doc_id % 2 = 0 THEN {LAYOUT} ELSE '' END AS xml FROM documents))"""
)
def c13_pages_from_layout(t: Tables) -> DataFrame:
    xml = F.when(F.col("doc_id") % 2 == 0, F.expr(LAYOUT)).otherwise("")
    return t.documents.select("doc_id", pages_from_layout(xml, T.chars(F.col("text"))).alias("pages"))


EXTENSIONS = ["pdf", "docx", "xlsx", "pptx", "txt", "dwg", "zip", "xyz"]
EXT_SQL = "list_extract(['" + "', '".join(EXTENSIONS) + "'], CAST(doc_id % 8 + 1 AS INTEGER))"


def some_ext(doc_id):
    """A file extension for each document, as if it came from such a file."""
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (doc_id % 8 + 1).cast("int"))


def page_policy(ext, n_chars):
    """Pages and, where there is no count, why."""
    pages = F.when(ext.isin("pdf", "docx", "pptx"), T.pages_of(n_chars)).when(ext.isin("xlsx"), F.lit(1).cast("bigint")).when(ext == "txt", T.pages_of(n_chars))
    reason = F.when(ext.isin("dwg"), "drawing: sheets are counted").when(ext.isin("zip"), "archive: see members").when(pages.isNull(), "no page count for this format")
    return F.struct(pages.cast("double").alias("pages"), reason.alias("reason"))


@query(f"SELECT doc_id, ext, CAST(CASE WHEN ext IN ('pdf', 'docx', 'pptx', 'txt') THEN {T.pages_sql('n')} WHEN ext = 'xlsx' THEN 1 END AS DOUBLE) AS pages, CASE ext WHEN 'dwg' THEN 'drawing: sheets are counted' WHEN 'zip' THEN 'archive: see members' WHEN 'xyz' THEN 'no page count for this format' END AS reason FROM (SELECT doc_id, {EXT_SQL} AS ext, {T.chars_sql('text')} AS n FROM documents)")
def c14_page_policy(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", some_ext(F.col("doc_id")).alias("ext"), T.chars(F.col("text")).alias("n")).select("doc_id", "ext", page_policy(F.col("ext"), F.col("n")).alias("p")).select("doc_id", "ext", "p.*")


BREAKS = "concat(repeat('<w:lastRenderedPageBreak/>', CAST(doc_id % 3 AS INT)), repeat('<w:br w:type=\"page\"/>', CAST(doc_id % 4 AS INT)), repeat('<w:sectPr>', CAST(doc_id % 2 AS INT)))"


@query(f"""SELECT doc_id, CASE WHEN r > 0 THEN r + 1 WHEN b + s > 0 THEN b + s + 1 ELSE {T.pages_sql('n')} END AS pages FROM (SELECT doc_id, {T.chars_sql('text')} AS n, {T.count_sql('xml', '<w:lastRenderedPageBreak/>')} AS r, {T.count_sql('xml', '<w:br w:type="page"/>')} AS b, {T.count_sql('xml', '<w:sectPr')} AS s FROM (SELECT *, {BREAKS} AS xml FROM documents))""")
def c15_document_pages(t: Tables) -> DataFrame:
    xml = F.expr(BREAKS)
    rendered, explicit = T.count_of(xml, "<w:lastRenderedPageBreak/>"), T.count_of(xml, '<w:br w:type="page"/>') + T.count_of(xml, "<w:sectPr")
    return t.documents.select("doc_id", F.when(rendered > 0, rendered + 1).when(explicit > 0, explicit + 1).otherwise(T.pages_of(T.chars(F.col("text")))).alias("pages"))


def page_ranges(pages: DataFrame, by: str, page: str) -> DataFrame:
    """Each group's pages as ranges such as 1-3、5."""
    row = F.row_number().over(Window.partitionBy(by).orderBy(page))
    islands = pages.select(by, page).distinct().withColumn("island", F.col(page) - row).groupBy(by, "island").agg(F.min(page).alias("lo"), F.max(page).alias("hi"))
    shown = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return islands.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("lo", shown.alias("s")))).alias("x")).select(by, F.array_join("x.s", "、").alias("ranges"))


@query("WITH p AS (SELECT DISTINCT l_suppkey, l_partkey % 97 AS page FROM lineitem), i AS (SELECT l_suppkey, page, page - row_number() OVER (PARTITION BY l_suppkey ORDER BY page) AS island FROM p), r AS (SELECT l_suppkey, min(page) AS lo, max(page) AS hi FROM i GROUP BY l_suppkey, island) SELECT l_suppkey, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, '、' ORDER BY lo) AS ranges FROM r GROUP BY 1")
def c16_page_ranges(t: Tables) -> DataFrame:
    return page_ranges(t.lineitem.select("l_suppkey", (F.col("l_partkey") % 97).alias("page")), "l_suppkey", "page")


UNSAFE = r'[\\/:*?"<>|]+'


@query(f"SELECT page_id, safe, CASE WHEN n = 1 THEN safe ELSE safe || '_' || (n - 1) END AS unique_name FROM (SELECT page_id, safe, row_number() OVER (PARTITION BY safe ORDER BY page_id) AS n FROM (SELECT page_id, substring(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*'), '{UNSAFE}', '_', 'g'), 1, 50) AS safe FROM pages))")
def c17_safe_names(t: Tables) -> DataFrame:
    safe = F.substring(F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]*", 0), UNSAFE, "_"), 1, 50)
    n = F.row_number().over(Window.partitionBy("safe").orderBy("page_id"))
    return t.pages.select("page_id", safe.alias("safe")).withColumn("n", n).select("page_id", "safe", F.when(F.col("n") == 1, F.col("safe")).otherwise(F.concat("safe", F.lit("_"), F.col("n") - 1)).alias("unique_name"))


#: Entities and what they stand for; the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&amp;", "&")]


def decode_entities(c):
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def _entities_sql(x: str) -> str:
    for entity, plain in ENTITIES:
        x = f"replace({x}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return x


@query(f"SELECT page_id, {_entities_sql('html')} AS plain FROM pages")
def c18_decode_entities(t: Tables) -> DataFrame:
    return t.pages.select("page_id", decode_entities(F.col("html")).alias("plain"))


SHEET = "concat(CASE WHEN o_orderkey % 3 = 0 THEN 't' ELSE '' END, o_orderkey, '-', o_custkey)"


@query(f"SELECT o_orderkey, nullif(regexp_extract(upper(trim({SHEET})), '\\d{{4,6}}'), '') AS code FROM orders")
def c19_sheet_codes(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", sheet_code(F.expr(SHEET)).alias("code"))


def sheet_code(c):
    """The first run of four to six digits; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(T.stripped(c)), r"\d{4,6}", 0), F.lit(""))


def column_index(c):
    """A spreadsheet column's number from its letters, from 1."""
    return F.aggregate(F.split(c, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))


COLUMN = "chr(CAST(65 + l_linenumber % 26 AS INT)) || CASE WHEN l_partkey % 2 = 0 THEN chr(CAST(65 + l_suppkey % 26 AS INT)) ELSE '' END"


@query(f"SELECT l_orderkey, l_linenumber, ref, CAST(CASE length(name) WHEN 1 THEN ascii(name) - 64 ELSE (ascii(name) - 64) * 26 + ascii(substring(name, 2)) - 64 END AS INTEGER) AS col, CAST(regexp_extract(ref, '\\d+$') AS INTEGER) AS row FROM (SELECT *, regexp_extract(ref, '^[A-Z]+') AS name FROM (SELECT *, {COLUMN} || l_orderkey AS ref FROM lineitem))")
def c20_cell_refs(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("ref", F.concat(F.expr(COLUMN), "l_orderkey")).select("l_orderkey", "l_linenumber", "ref", column_index(F.regexp_extract("ref", "^[A-Z]+", 0)).alias("col"), F.regexp_extract("ref", r"\d+$", 0).cast("int").alias("row"))


NAME = "CASE o_orderkey % 6 WHEN 0 THEN md5(CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('Sheet', o_custkey) WHEN 2 THEN concat('1-', o_orderkey % 50) WHEN 3 THEN concat('wc_', md5(CAST(o_custkey AS STRING))) WHEN 4 THEN concat('plan ', o_orderpriority, '.pdf') ELSE concat('a', o_orderkey % 10) END"
# Names that are hashes, with and without a prefix, and names that tell nothing, by kind.
HASHES = [r"^[a-fA-F0-9]{16,}$", r"^[a-fA-F0-9]{8}-([a-fA-F0-9]{4}-){3}[a-fA-F0-9]{12}$", r"^(wc_|file_)[0-9a-f]{10,}"]
GENERIC = [r"^\d+[)-]\d+\)?$", r"^\d+[)-]\d+\)\(\d+\)$", r"^[\p{L}\p{N}]{0,3}$", r"^(?i:Sheet|Doc|Document|File|Image|Pic|图|档|表|页)\d*$"]
HASH, NUMBERED_NAME = "|".join(HASHES), "|".join(GENERIC)


def name_flags(name):
    """Whether a name looks like a hash, suspicious, and numbered or generic."""
    stem = F.regexp_replace(name, r"(.)\.[^.]+$", "$1")
    return [(F.length(name) >= 8) & name.rlike(HASH), (F.length(name) >= 8) & ~name.rlike(r"[\x{4E00}-\x{9FFF}]") & stem.rlike("[a-fA-F0-9]{12,}"), stem.rlike(NUMBERED_NAME)]


@query(f"SELECT o_orderkey, name, length(name) >= 8 AND regexp_matches(name, '{HASH}') AS hash_like, length(name) >= 8 AND regexp_matches(stem, '[a-fA-F0-9]{{12,}}') AS suspicious, regexp_matches(stem, '{NUMBERED_NAME}') AS generic FROM (SELECT *, regexp_replace(name, '(.)\\.[^.]+$', '\\1') AS stem FROM (SELECT o_orderkey, {NAME.replace('STRING', 'VARCHAR')} AS name FROM orders))")
def c21_name_heuristics(t: Tables) -> DataFrame:
    a, b, c = name_flags(F.col("name"))
    return t.orders.select("o_orderkey", F.expr(NAME).alias("name")).select("o_orderkey", "name", a.alias("hash_like"), b.alias("suspicious"), c.alias("generic"))


def name_hash(name):
    """A stable hash of a name: 31 times what came before plus each UTF-16 unit, in 32 bits without sign."""
    raw = F.hex(F.encode(name, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), F.greatest(F.length(raw) / 4 - 1, F.lit(0)).cast("int")), lambda i: F.coalesce(F.conv(raw.substr(4 * i + 1, F.lit(4)), 16, 10).cast("bigint"), F.lit(0)))
    wrapped = lambda x: F.abs(F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31))
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda h, c: F.when(wrapped(31 * h + c) == 1 << 31, 0).otherwise(wrapped(31 * h + c)))


_WRAPPED = f"abs((31 * h + c + {1 << 31}) % {1 << 32} - {1 << 31})"


@query(f"SELECT o_orderkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda h, c: CASE WHEN {_WRAPPED} = {1 << 31} THEN 0 ELSE {_WRAPPED} END) AS hash FROM (SELECT o_orderkey, {NAME.replace('STRING', 'VARCHAR')} AS name FROM orders)")
def c26_name_hash(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", name_hash(F.expr(NAME)).alias("hash"))


def clean_mtext(c):
    """Drawing text without its formatting codes."""
    for code, plain in (("\\P", "\n"), ("\\p", "\n"), ("\\~", " "), ("\\^I", " "), ("\\^J", " ")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    c = F.regexp_replace(c, r"\\[A-Za-z][^;{}]*;", "")
    for mark in ("{", "}", "\\"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    return c


MTEXT = r"concat('{\\fSimSun|b0;', p_name, '}\\P\\H2.5;', p_type, '\\~x')"


@query("SELECT p_partkey, replace(replace(replace(regexp_replace(replace(replace(m, '\\P', chr(10)), '\\~', ' '), '\\\\[A-Za-z][^;{}]*;', '', 'g'), '{', ''), '}', ''), '\\', '') AS plain FROM (SELECT p_partkey, concat('{\\fSimSun|b0;', p_name, '}\\P\\H2.5;', p_type, '\\~x') AS m FROM part)")
def c24_clean_mtext(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", clean_mtext(F.expr(MTEXT)).alias("plain"))


KEY = f"[\\p{{P}}\\p{{S}}{T.WS}]+"


def line_key(c):
    """A line in lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(c), KEY, "")


@query(f"SELECT doc_id, pos, regexp_replace(lower(line), '{KEY}', '', 'g') AS key FROM {LINES}")
def c25_line_keys(t: Tables) -> DataFrame:
    return U.lines(t.documents).select("doc_id", "pos", line_key(F.col("line")).alias("key"))


@query(f"SELECT conv_id, turn, CAST(len(x) AS INTEGER) AS n_tokens, x[1] AS first, x[len(x)] AS last FROM (SELECT conv_id, turn, regexp_extract_all({T.HAN_SQL}, '[{T.HAN}]|[\\p{{N}}_A-Za-z\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{24F}}]+|(?s:.)') AS x FROM conversations)")
def c27_diff_tokens(t: Tables) -> DataFrame:
    x = U.tokens(T.with_han(F.col("text")))
    return t.conversations.select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", F.size("x").alias("n_tokens"), F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"))


STOPPED = "translate(text, '.,', '。；')"


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, s AS sentence FROM (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS s FROM (SELECT doc_id, {U.sentences_sql(STOPPED)} AS x FROM documents))")
def c28_sentences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(U.sentences(F.translate("text", ".,", "。；"))).alias("pos", "sentence"))


@query(f"SELECT conv_id, turn, CAST(len({U.sentences_sql('text', U.LONG_ENDS)}) AS INTEGER) AS n_sentences FROM conversations")
def c29_sentences_wide(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.size(U.sentences(F.col("text"), U.LONG_ENDS)).alias("n_sentences"))
