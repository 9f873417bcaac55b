"""Queries of cleaning and decisions: D rows, routes and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.layers import BAD, CJK_CONTENT, CJK_PUNCT, EXOTIC, LEADERS, is_poisoned, sanitize_paragraph
from quillspan.operators import units as U
from quillspan.plans.registry import Tables, query

POISONED_SQL = f"CASE WHEN x = '' THEN true WHEN length(s) < 10 THEN false ELSE {T.count_sql('s', r'\((?:cid|CID):')} >= 3 OR {T.count_sql('s', BAD)} >= greatest(8.0, length(s) * 0.05) OR {T.count_sql('s', EXOTIC)} >= greatest(20.0, length(s) * 0.30) END"
#: Lines, some with glyph references or private-use characters put in by their number.
DIRTY = "CASE WHEN doc_id % 7 = 0 THEN concat(text, '(cid:12)(cid:7)(CID:9)') WHEN doc_id % 5 = 0 THEN translate(text, 'eai', '') ELSE text END"


@query(f"SELECT doc_id, {POISONED_SQL} AS poisoned FROM (SELECT doc_id, x, {T.stripped_sql('x')} AS s FROM (SELECT doc_id, {DIRTY} AS x FROM documents))")
def d01_poisoned(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", is_poisoned(F.expr(DIRTY)).alias("poisoned"))


#: Vowels of some documents as Han, so that shares differ.
MIXED = "CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeiou', '中文字数统') WHEN doc_id % 3 = 1 THEN translate(text, 'z,', '字，') ELSE concat(text, '・・・・') END"


@query(f"SELECT doc_id, CASE WHEN solid = 0 THEN '' WHEN n < 0.15::DOUBLE * solid THEN {T.stripped_sql(f"regexp_replace(regexp_replace(p, '{CJK_CONTENT}', '', 'g'), '{CJK_PUNCT}', '', 'g')")} ELSE {T.stripped_sql('p')} END AS clean FROM (SELECT doc_id, p, {T.chars_sql('p')} AS solid, {T.count_sql('p', CJK_CONTENT)} AS n FROM (SELECT doc_id, regexp_replace({MIXED}, '{LEADERS}', '', 'g') AS p FROM documents))")
def d02_sanitized(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sanitize_paragraph(F.expr(MIXED)).alias("clean"))


def keep_ocr_line(line):
    """Whether a recognised line is more than one to three stray East-Asian characters."""
    stray = T.count_of(line, f"[{T.OCR_CJK}]").between(1, 3) & ~line.rlike("[A-Za-z]{2,}") & ~line.rlike(r"\p{Nd}")
    return (line != "") & ~stray


OCR_LINES = "(SELECT doc_id, pos, CASE WHEN pos % 4 = 3 THEN substring(translate(line, 'aeiou', '中文字数统'), 1, 1 + doc_id % 3) ELSE line END AS line FROM " + U.LINES_SQL + ")"
STRAY_SQL = f"({T.count_sql('line', f'[{T.OCR_CJK}]')} BETWEEN 1 AND 3 AND NOT regexp_matches(line, '[A-Za-z]{{2,}}') AND NOT regexp_matches(line, '\\p{{Nd}}'))"


@query(f"SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS clean FROM {OCR_LINES} WHERE NOT {STRAY_SQL} AND line <> '' GROUP BY 1")
def d03_ocr_noise(t: Tables) -> DataFrame:
    line = F.when(F.col("pos") % 4 == 3, F.expr("substring(translate(line, 'aeiou', '中文字数统'), 1, CAST(1 + doc_id % 3 AS INT))")).otherwise(F.col("line"))
    kept = U.lines(t.documents).withColumn("line", line).where(keep_ocr_line(F.col("line")))
    return kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("x")).select("doc_id", F.array_join("x.line", "\n").alias("clean"))


@query(f"SELECT doc_id, CASE WHEN fe > 0 AND fe < 0.15::DOUBLE * chars THEN regexp_replace(x, '[{T.FAR}]', '', 'g') ELSE x END AS clean FROM (SELECT doc_id, x, {T.metrics_sql('x')} FROM (SELECT doc_id, {MIXED} AS x FROM documents))")
def d04_strip_far_east(t: Tables) -> DataFrame:
    x = F.expr(MIXED)
    return t.documents.select("doc_id", F.when((T.fe(x) > 0) & (T.fe(x) < 0.15 * T.chars(x)), F.regexp_replace(x, f"[{T.FAR}]", "")).otherwise(x).alias("clean"))


@query(f"SELECT doc_id, CASE WHEN {T.count_sql('x', f'[{T.IDEOGRAPH}]')} > 0.15::DOUBLE * length(x) THEN x ELSE regexp_replace(x, '[{T.OCR_CJK}]', '', 'g') END AS clean FROM (SELECT doc_id, {MIXED} AS x FROM documents)")
def d05_ocr_postfilter(t: Tables) -> DataFrame:
    x = F.expr(MIXED)
    return t.documents.select("doc_id", F.when(T.count_of(x, f"[{T.IDEOGRAPH}]") > 0.15 * F.length(x), x).otherwise(F.regexp_replace(x, f"[{T.OCR_CJK}]", "")).alias("clean"))


#: Beginnings of lines that belong to a file's structure.
STRUCTURE = "/type /subtype /filter /length /root /parent /resources /font /encoding /contents /mediabox /cropbox /rotate /annots /pages /kids /count /catalog stream endstream obj endobj xref trailer startxref flatedecode helvetica arial times courier symbol zapf winansi identity truetype embedded subset fontfile cmap baseline".split()
STRUCTURED = "CASE pos % 6 WHEN 0 THEN '/Type /Page /Parent 3 0 R' WHEN 1 THEN concat(doc_id, ' 0 obj') WHEN 2 THEN '12.5-3' WHEN 3 THEN concat('a/b/c/d ', line) ELSE line END"
STRUCTURE_PATTERN = "^(?:" + "|".join(STRUCTURE) + ")"


def keep_text_line(line):
    """Whether an extracted line is text rather than a file's structure: letters, no key words, few commands."""
    low = F.lower(line)
    commands = line.rlike(r"/\w+") & ~line.rlike(r"[^\x{00}-\x{7F}]") & (T.count_of(line, "/") >= 3)
    return (F.length(line) > 1) & line.rlike(r"\p{L}") & ~low.rlike(" obj|endobj|xref|trailer") & ~commands & ~low.rlike(STRUCTURE_PATTERN)


@query(f"SELECT doc_id, pos, line FROM (SELECT doc_id, pos, {STRUCTURED} AS line FROM {U.LINES_SQL}) WHERE length(line) > 1 AND regexp_matches(line, '\\p{{L}}') AND NOT regexp_matches(lower(line), ' obj|endobj|xref|trailer') AND NOT (regexp_matches(line, '/\\w+') AND NOT regexp_matches(line, '[^\\x{{00}}-\\x{{7F}}]') AND {T.count_sql('line', '/')} >= 3) AND NOT regexp_matches(lower(line), '{STRUCTURE_PATTERN}')")
def d06_text_lines(t: Tables) -> DataFrame:
    return U.lines(t.documents).withColumn("line", F.expr(STRUCTURED)).where(keep_text_line(F.col("line")))


STRUCT_WORDS = [" endobj", " xref", " trailer", " startxref", " stream", " endstream"]
TRUSTED = "CASE doc_id % 5 WHEN 0 THEN concat(text, ' xref trailer') WHEN 1 THEN concat('7 0 obj ', text) WHEN 2 THEN replace(text, ' ', ' /tf ') ELSE text END"


def is_reliable(c):
    """Whether a text has fewer than two structure words, few commands and no object header."""
    low = F.lower(c)
    found = sum((F.contains(low, F.lit(w)).cast("int") for w in STRUCT_WORDS), F.lit(0))
    commands = T.count_of(low, "/[a-z]+")
    return (T.stripped(c) != "") & (found < 2) & ~((commands > 0) & (commands > F.floor(F.length(c) / 20))) & ~c.rlike(r"\d+\s+\d+\s+obj|endobj")


@query(f"SELECT doc_id, {T.stripped_sql('x')} <> '' AND {' + '.join(f"contains(lower(x), '{w}')::INT" for w in STRUCT_WORDS)} < 2 AND NOT (c > 0 AND c > length(x) // 20) AND NOT regexp_matches(x, '\\d+\\s+\\d+\\s+obj|endobj') AS reliable FROM (SELECT *, {T.count_sql('lower(x)', '/[a-z]+')} AS c FROM (SELECT doc_id, {TRUSTED} AS x FROM documents))")
def d07_reliable(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", is_reliable(F.expr(TRUSTED)).alias("reliable"))


@query("SELECT doc_id, x <> '' AND len(regexp_extract_all(x, '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{FFFD}]')) > 0.20::DOUBLE * length(x) AS garbled FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN translate(text, 'aeio', '\x01\x02\x03\x05') ELSE text END AS x FROM documents)")
def d08_garbled(t: Tables) -> DataFrame:
    x = F.when(F.col("doc_id") % 4 == 0, F.translate("text", "aeio", "\x01\x02\x03\x05")).otherwise(F.col("text"))
    return t.documents.select("doc_id", ((x != "") & (T.count_of(x, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{FFFD}]") > 0.20 * F.length(x))).alias("garbled"))


#: Words of a drawing's own tables.
STOP_WORDS = ["standard", "continuous", "bylayer", "byblock", "model", "layout1", "acad", "autocad"]


def looks_real(s, least=4):
    """Whether a run found among bytes is text: three letters, few digits and symbols, not a short upper-case code, and a vowel or a space."""
    n, letters, digits = F.length(s), T.count_of(s, r"\p{L}"), T.count_of(s, r"\p{Nd}")
    short_upper = ~s.rlike(r"\p{Ll}") & (n <= 6)
    return (n >= least) & ~F.lower(s).isin(STOP_WORDS) & (letters >= 3) & (digits <= 0.5 * n) & (n - letters - digits <= 0.35 * n) & ~short_upper & (F.lower(s).rlike("[aeiou]") | F.contains(s, F.lit(" ")))


PIECES = "unnest(string_split(text, ' '))"


@query("SELECT DISTINCT w AS piece, length(w) >= 4 AND lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + f") AND a >= 3 AND d <= 0.5::DOUBLE * length(w) AND length(w) - a - d <= 0.35::DOUBLE * length(w) AND NOT (NOT regexp_matches(w, '\\p{{Ll}}') AND length(w) <= 6) AND (regexp_matches(lower(w), '[aeiou]') OR contains(w, ' ')) AS looks_real FROM (SELECT w, {T.count_sql('w', '\\p{L}')} AS a, {T.count_sql('w', '\\p{Nd}')} AS d FROM (SELECT {PIECES} AS w FROM documents))")
def d09_real_text(t: Tables) -> DataFrame:
    pieces = t.documents.select(F.explode(F.split("text", " ", -1)).alias("piece")).distinct()
    return pieces.withColumn("looks_real", looks_real(F.col("piece")))


COMMON_HAN = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处队南给色光门即保治北造百规热领七海口东导器压志世金增争济阶油思术极交受联什认六共权收证改清己美再采转更单风切打白教速花带安场身车例真务具万每目至达走积示议声报斗完类八离华名确才科张信马节话米整空元况今集温传土许步群广石记需段研界拉林律叫且究观越织装影算低持音众书布复容儿须际商非验连断深难近矿千周委素技备半办青省列习响约支般史感劳便团往酸历市克何除消构府称太准精值号率族维划选标写存候毛亲快效斯院查江型眼王按格养易置派层片始却专状育厂京识适属圆包火住调满县局照参红细引听该铁价严字"


@query(f"SELECT doc_id, cjk >= 8 AND cjk / greatest(n, 1) >= 0.7 AND common >= 2 AS real_cjk FROM (SELECT doc_id, length(x) AS n, {T.count_sql('x', '[\\x{4E00}-\\x{9FFF}]')} AS cjk, {T.count_sql('x', f'[{COMMON_HAN}]')} AS common FROM (SELECT doc_id, regexp_replace(translate(text, 'aeioutrs', CASE WHEN doc_id % 2 = 0 THEN '中文字数统的是在' ELSE '鎌芁哅皜鎌芁哅皜' END), CASE WHEN doc_id % 3 = 0 THEN '[ -~]' ELSE '~' END, '', 'g') AS x FROM documents))")
def d10_real_han(t: Tables) -> DataFrame:
    """Whole texts are judged."""
    swapped = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "aeioutrs", "中文字数统的是在")).otherwise(F.translate("text", "aeioutrs", "鎌芁哅皜鎌芁哅皜"))
    x = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(swapped, "[ -~]", "")).otherwise(F.regexp_replace(swapped, "~", ""))
    n, cjk, common = F.length("x"), T.count_of(F.col("x"), r"[\x{4E00}-\x{9FFF}]"), T.count_of(F.col("x"), f"[{COMMON_HAN}]")
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", ((cjk >= 8) & (cjk / F.greatest(n, F.lit(1)) >= 0.7) & (common >= 2)).alias("real_cjk"))


ROUTE_SQL = "CASE WHEN pages = 0 THEN 'ocr' WHEN cid >= 3 THEN 'layout' WHEN chars < 50 * pages THEN 'ocr' WHEN fe = 0 AND other > 0.2::DOUBLE * chars THEN 'layout' ELSE 'native' END"


@query(f"SELECT doc_id, {ROUTE_SQL} AS route FROM (SELECT doc_id, doc_id % 6 AS pages, {T.count_sql('x', r'\(cid:')} AS cid, {T.count_sql('x', '[^\\x{00}-\\x{7F}]')} AS other, {T.metrics_sql('x')} FROM (SELECT doc_id, {DIRTY} AS x FROM documents))")
def d11_engine_route(t: Tables) -> DataFrame:
    x = F.expr(DIRTY)
    stats = t.documents.select("doc_id", (F.col("doc_id") % 6).alias("pages"), T.count_of(x, r"\(cid:").alias("cid"), T.count_of(x, r"[^\x{00}-\x{7F}]").alias("other"), *T.metrics(x))
    route = F.when(F.col("pages") == 0, "ocr").when(F.col("cid") >= 3, "layout").when(F.col("chars") < 50 * F.col("pages"), "ocr").when((F.col("fe") == 0) & (F.col("other") > 0.2 * F.col("chars")), "layout").otherwise("native")
    return stats.select("doc_id", route.alias("route"))


LOSS = "CASE WHEN cjk >= 50 AND common < 0.05::DOUBLE * cjk THEN 'garbled' WHEN chars >= 200 AND cjk < 0.05::DOUBLE * chars THEN 'sparse' WHEN cjk > 3000 THEN 'dense' ELSE 'fine' END"


@query(f"SELECT doc_id, {LOSS} AS verdict FROM (SELECT doc_id, {T.chars_sql('x')} AS chars, {T.count_sql('x', '[\\x{4E00}-\\x{9FFF}]')} AS cjk, {T.count_sql('x', f'[{COMMON_HAN}]')} AS common FROM (SELECT doc_id, translate(text, 'aeiou', CASE doc_id % 3 WHEN 0 THEN '中文字数统' WHEN 1 THEN '鎌芁哅皜鎌' ELSE 'aeiou' END) AS x FROM documents))")
def d12_encoding_loss(t: Tables) -> DataFrame:
    x = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeiou", "中文字数统")).when(F.col("doc_id") % 3 == 1, F.translate("text", "aeiou", "鎌芁哅皜鎌")).otherwise(F.col("text"))
    stats = t.documents.select("doc_id", x.alias("x")).select("doc_id", T.chars(F.col("x")).alias("chars"), T.count_of(F.col("x"), r"[\x{4E00}-\x{9FFF}]").alias("cjk"), T.count_of(F.col("x"), f"[{COMMON_HAN}]").alias("common"))
    verdict = F.when((F.col("cjk") >= 50) & (F.col("common") < 0.05 * F.col("cjk")), "garbled").when((F.col("chars") >= 200) & (F.col("cjk") < 0.05 * F.col("chars")), "sparse").when(F.col("cjk") > 3000, "dense").otherwise("fine")
    return stats.select("doc_id", verdict.alias("verdict"))


REPLACE = "CASE WHEN new_n = 0 THEN false WHEN old_n >= 200 AND old_common >= 0.10::DOUBLE * old_n THEN false WHEN old_n > 0 AND new_n > 3.5::DOUBLE * old_n THEN false ELSE new_common >= 0.10::DOUBLE * new_n AND diversity < 0.7::DOUBLE END"


@query(f"SELECT o_orderkey, {REPLACE} AS replaces FROM (SELECT o_orderkey, o_custkey % 400 AS old_n, o_custkey % 90 AS old_common, o_orderkey % 900 AS new_n, o_orderkey % 120 AS new_common, (o_orderkey % 10) / 10 AS diversity FROM orders)")
def d13_recovery_gate(t: Tables) -> DataFrame:
    stats = t.orders.selectExpr("o_orderkey", "o_custkey % 400 AS old_n", "o_custkey % 90 AS old_common", "o_orderkey % 900 AS new_n", "o_orderkey % 120 AS new_common", "(o_orderkey % 10) / 10 AS diversity")
    old, new = F.col("old_n"), F.col("new_n")
    gate = F.when(new == 0, False).when((old >= 200) & (F.col("old_common") >= 0.10 * old), False).when((old > 0) & (new > 3.5 * old), False)
    return stats.select("o_orderkey", gate.otherwise((F.col("new_common") >= 0.10 * new) & (F.col("diversity") < 0.7)).alias("replaces"))


@query("SELECT l_orderkey, l_linenumber, coalesce(plot AND is_on AND NOT frozen, true) AS visible FROM lineitem LEFT JOIN (SELECT s_suppkey AS layer, s_nationkey <> 7 AS plot, s_acctbal > 0 AS is_on, s_nationkey = 11 AS frozen FROM supplier WHERE s_acctbal > -500) ON l_suppkey = layer WHERE l_returnflag <> 'R'")
def d14_layer_visibility(t: Tables) -> DataFrame:
    """Returned lines stand for outside references, which are left out; suppliers for layers, some of which the file doesn't list."""
    layers = t.supplier.where("s_acctbal > -500").selectExpr("s_suppkey AS layer", "s_nationkey <> 7 AS plot", "s_acctbal > 0 AS is_on", "s_nationkey = 11 AS frozen")
    entities = t.lineitem.where("l_returnflag <> 'R'")
    return entities.join(layers, F.col("l_suppkey") == F.col("layer"), "left").select("l_orderkey", "l_linenumber", F.coalesce(F.col("plot") & F.col("is_on") & ~F.col("frozen"), F.lit(True)).alias("visible"))


SLIDE = "CASE p_partkey % 4 WHEN 0 THEN ' Footer ' WHEN 1 THEN '页码' ELSE p_name END"


@query(f"SELECT p_partkey, length({T.stripped_sql('s')}) <= 15 AND lower({T.stripped_sql('s')}) IN (" + ", ".join(f"'{p}'" for p in T.PLACEHOLDERS) + f") AS placeholder FROM (SELECT p_partkey, {SLIDE} AS s FROM part)")
def d15_placeholders(t: Tables) -> DataFrame:
    s = T.stripped(F.expr(SLIDE))
    return t.part.select("p_partkey", ((F.length(s) <= 15) & F.lower(s).isin(T.PLACEHOLDERS)).alias("placeholder"))


@query("SELECT doc_id, image_only, n_images, coalesce(toxic, 0) = 1 AS flagged FROM (SELECT doc_id, n_chars < 60 AS image_only, doc_id % 4 AS n_images FROM documents) LEFT JOIN labels USING (doc_id) WHERE image_only OR n_images = 3 OR coalesce(toxic, 0) = 1")
def d16_unreliable(t: Tables) -> DataFrame:
    found = t.documents.selectExpr("doc_id", "n_chars < 60 AS image_only", "doc_id % 4 AS n_images").join(t.labels, "doc_id", "left")
    flagged = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    return found.where(F.col("image_only") | (F.col("n_images") == 3) | flagged).select("doc_id", "image_only", "n_images", flagged.alias("flagged"))


#: Extensions of each family of formats.
FAMILIES = {"archive": ["zip", "rar", "7z", "tar", "gz", "tgz", "bz2", "xz"], "ooxml": ["docx", "xlsx", "xlsm", "pptx"], "pdf": ["pdf"], "legacy": ["doc", "xls", "ppt"], "drawing": ["dwg", "dxf"], "image": ["png", "jpg", "jpeg", "bmp", "gif", "webp", "tif", "tiff"]}


def route(ext):
    """The family that reads a file; text for all others."""
    out = F.lit("text")
    for name, exts in FAMILIES.items():
        out = F.when(ext.isin(exts), name).otherwise(out)
    return out


EXTS = [e for v in FAMILIES.values() for e in v] + ["md", ""]
FILE = f"concat('f', o_orderkey, '.', element_at(array({', '.join(repr(e) for e in EXTS)}), CAST(o_orderkey % {len(EXTS)} + 1 AS INT)))"
FILE_SQL = f"concat('f', o_orderkey, '.', list_extract([{', '.join(repr(e) for e in EXTS)}], CAST(o_orderkey % {len(EXTS)} + 1 AS INT)))"
ROUTES_SQL = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in FAMILIES.items()) + " ELSE 'text' END"


def extension(name):
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


@query(f"SELECT o_orderkey, ext, {ROUTES_SQL} AS family FROM (SELECT o_orderkey, lower(regexp_extract({FILE_SQL}, '\\.([^.]*)$', 1)) AS ext FROM orders)")
def a03_routes(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", extension(F.expr(FILE)).alias("ext")).withColumn("family", route(F.col("ext")))


#: Media types and extensions.
MIME = {"pdf": "application/pdf", "txt": "text/plain", "csv": "text/csv", "xml": "text/xml", "json": "application/json", "html": "text/html", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "dwg": "application/dwg", "dxf": "application/dxf", "zip": "application/zip"}
MIME_SQL = "CASE mime " + " ".join(f"WHEN '{m}' THEN '{e}'" for e, m in MIME.items()) + " END"


def _mapped(c, table: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


@query(f"SELECT page_id, lower(coalesce(nullif(regexp_extract(name, '.\\.([^./]+)$', 1), ''), CASE WHEN mime LIKE 'image/%' THEN coalesce({MIME_SQL}, 'png') ELSE {MIME_SQL} END, nullif(regexp_extract(url, '[^/]/.*\\.([^./?]+)$', 1), ''), '')) AS ext FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'x' || page_id || '.PDF' ELSE '' END AS name, CASE page_id % 4 WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'text/plain' ELSE 'x/y' END AS mime FROM pages)")
def a04_guess_extension(t: Tables) -> DataFrame:
    p = t.pages.selectExpr("page_id", "url", "CASE page_id % 3 WHEN 0 THEN concat('x', page_id, '.PDF') ELSE '' END AS name", "CASE page_id % 4 WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'text/plain' ELSE 'x/y' END AS mime")
    by_mime = _mapped(F.col("mime"), {m: e for e, m in MIME.items()})
    by_mime = F.when(F.col("mime").startswith("image/"), F.coalesce(by_mime, F.lit("png"))).otherwise(by_mime)
    found = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return p.select("page_id", F.lower(F.coalesce(found("name", r".\.([^./]+)$"), by_mime, found("url", r"[^/]/.*\.([^./?]+)$"), F.lit(""))).alias("ext"))


@query("SELECT o_orderkey, coalesce(CASE ext " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in MIME.items()) + f" END, '*/*') AS mime FROM (SELECT o_orderkey, lower(regexp_extract({FILE_SQL}, '\\.([^.]*)$', 1)) AS ext FROM orders)")
def o20_mime_types(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.coalesce(_mapped(extension(F.expr(FILE)), MIME), F.lit("*/*")).alias("mime"))


#: Endings of archives, those of two parts first.
ARCHIVES = [("zip", "zip"), ("rar", "rar"), ("7z", "7z"), ("tar.gz", "tar"), ("tgz", "tar"), ("tar.bz2", "tar"), ("tbz2", "tar"), ("tar.xz", "tar"), ("txz", "tar"), ("tar", "tar"), ("gz", "single"), ("bz2", "single"), ("xz", "single")]
ENDINGS = [e for e, _ in ARCHIVES] + ["pdf", "gz.txt"]
PACKED = f"concat('D', o_orderkey, '.', element_at(array({', '.join(repr(e.upper()) for e in ENDINGS)}), CAST(o_custkey % {len(ENDINGS)} + 1 AS INT)))"


def archive_kind(path):
    out = F.lit(None).cast("string")
    for ending, kind in reversed(ARCHIVES):
        out = F.when(F.lower(path).endswith("." + ending), kind).otherwise(out)
    return out


@query("SELECT o_orderkey, CASE " + " ".join(f"WHEN ends_with(lower(p), '.{e}') THEN '{k}'" for e, k in ARCHIVES) + f" END AS kind FROM (SELECT o_orderkey, {PACKED.replace('element_at(array(', 'list_extract([').replace('), CAST', '], CAST')} AS p FROM orders)")
def b01_archive_kind(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", archive_kind(F.expr(PACKED)).alias("kind"))


MEMBER = "CASE p_partkey % 5 WHEN 0 THEN concat('../', p_name) WHEN 1 THEN concat('/etc/', p_brand) WHEN 2 THEN concat('a/../../', p_size) WHEN 3 THEN concat('a\\\\..\\\\', p_name) ELSE concat('docs/', p_name, '.txt') END"


def is_safe_member(path):
    """Whether a member's path stays inside its archive."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~p.startswith("/") & ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.rlike("^[A-Za-z]:")


@query("SELECT p_partkey, NOT starts_with(p, '/') AND NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') AND NOT regexp_matches(p, '^[A-Za-z]:') AS safe FROM (SELECT p_partkey, replace(" + MEMBER.replace("\\\\", "\\") + ", '\\', '/') AS p FROM part)")
def b02_safe_members(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", is_safe_member(F.expr(MEMBER)).alias("safe"))


#: What a drawing program writes into a file saved without a readable copy.
MARKERS = ["saved without pdf", "ohne pdf-inhalt", "sans contenu pdf", "未包含 pdf"]


@query(f"SELECT doc_id, pos, line FROM (SELECT doc_id, pos, CASE WHEN pos % 9 = 4 THEN 'This file was Saved without PDF content' ELSE line END AS line FROM {U.LINES_SQL}) WHERE NOT regexp_matches(lower(line), '{'|'.join(MARKERS)}')")
def a20_drop_markers(t: Tables) -> DataFrame:
    line = F.when(F.col("pos") % 9 == 4, "This file was Saved without PDF content").otherwise(F.col("line"))
    return U.lines(t.documents).withColumn("line", line).where(~F.lower("line").rlike("|".join(MARKERS)))


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, s AS text FROM (SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS s FROM (SELECT page_id, {U.HARVEST_SQL} AS x FROM pages))")
def a21_tag_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.posexplode(U.harvest_tags(F.col("html"))).alias("pos", "text"))


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM {U.LINES_SQL}")
def a06_text_lines(t: Tables) -> DataFrame:
    return U.lines(t.documents)


@query(f"SELECT conv_id, turn, s <> '' AS ok, CASE WHEN s = '' THEN 'no text' END AS error FROM (SELECT conv_id, turn, {T.stripped_sql("CASE WHEN turn % 4 = 3 THEN chr(10) || ' ' ELSE text END")} AS s FROM conversations)")
def a07_text_or_error(t: Tables) -> DataFrame:
    s = T.stripped(F.when(F.col("turn") % 4 == 3, "\n ").otherwise(F.col("text")))
    return t.conversations.select("conv_id", "turn", (s != "").alias("ok"), F.when(s == "", "no text").alias("error"))
