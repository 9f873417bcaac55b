"""Queries of totals, duplicates, alignment, sequences and drawings: E to M and O rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import sequences as S
from quillspan.operators import units as U
from quillspan.plans.counting import EXT_SQL, line_key, sheet_code, some_ext
from quillspan.plans.counting import KEY as KEY_CLASS
from quillspan.plans.registry import Tables, query
from quillspan.streaming.journal import followed, latest_results

LINES = U.LINES_SQL
DOC_METRICS = f"(SELECT doc_id, source, lang, {T.metrics_sql('text')} FROM documents)"


def _metrics(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "lang", *T.metrics(F.col("text")))


@query(f"SELECT coalesce(source, '合计') AS file, count(*) AS files, {T.TOTALS_SQL} FROM {DOC_METRICS} GROUP BY ROLLUP (source)")
def e01_batch_total(t: Tables) -> DataFrame:
    return _metrics(t).rollup("source").agg(F.count("*").alias("files"), *T.totals()).select(F.coalesce("source", F.lit("合计")).alias("file"), "files", *T.TOTALS)


PARTS = "list_extract(['member', 'hidden', 'notes', 'text', 'number'], CAST(doc_id % 5 + 1 AS INTEGER))"


@query(f"SELECT m.source, {T.TOTALS_SQL} FROM (SELECT *, {PARTS} AS part FROM {DOC_METRICS}) m LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1, part IN ('member', 'text', 'number')) GROUP BY 1")
def e02_selected_total(t: Tables) -> DataFrame:
    part = F.element_at(F.array(*map(F.lit, ["member", "hidden", "notes", "text", "number"])), (F.col("doc_id") % 5 + 1).cast("int"))
    chosen = F.coalesce(F.col("quality") == 1, part.isin("member", "text", "number"))
    return _metrics(t).join(t.labels, "doc_id", "left").where(chosen).groupBy("source").agg(*T.totals())


@query(f"SELECT coalesce(source, '') AS book, coalesce(lang, '*') AS sheet, {T.TOTALS_SQL} FROM {DOC_METRICS} GROUP BY GROUPING SETS ((source, lang), (source))")
def e03_sheet_stats(t: Tables) -> DataFrame:
    return _metrics(t).groupingSets([[F.col("source"), F.col("lang")], [F.col("source")]], "source", "lang").agg(*T.totals()).select(F.coalesce("source", F.lit("")).alias("book"), F.coalesce("lang", F.lit("*")).alias("sheet"), *T.TOTALS)


@query(f"SELECT conv_id, role AS part, {T.TOTALS_SQL} FROM (SELECT conv_id, role, {T.metrics_sql('text')} FROM conversations WHERE role <> 'user') GROUP BY 1, 2")
def e04_notes_total(t: Tables) -> DataFrame:
    return t.conversations.where("role <> 'user'").select("conv_id", F.col("role").alias("part"), *T.metrics(F.col("text"))).groupBy("conv_id", "part").agg(*T.totals())


PAGED = f"(SELECT *, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 + 1 END AS pages, doc_id % 11 <> 0 AS ok FROM {DOC_METRICS})"


@query(f"SELECT source AS archive, CAST(sum(coalesce(pages, {T.pages_sql('chars')})) AS BIGINT) AS pages FROM {PAGED} GROUP BY 1")
def e05_archive_pages(t: Tables) -> DataFrame:
    pages = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 + 1)
    return _metrics(t).groupBy(F.col("source").alias("archive")).agg(F.sum(F.coalesce(pages, T.pages_of(F.col("chars")))).alias("pages"))


@query(f"SELECT source AS archive, count(*) FILTER (WHERE ok) AS members, count(*) FILTER (WHERE NOT ok) AS failed, CAST(sum(words) FILTER (WHERE ok) AS BIGINT) AS words, CAST(sum(coalesce(pages, {T.pages_sql('chars')})) FILTER (WHERE ok) AS BIGINT) AS pages FROM {PAGED} GROUP BY 1")
def b06_archive_rollup(t: Tables) -> DataFrame:
    ok = F.col("doc_id") % 11 != 0
    pages = F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 + 1), T.pages_of(F.col("chars")))
    return _metrics(t).groupBy(F.col("source").alias("archive")).agg(F.count_if(ok).alias("members"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col("words"))).alias("words"), F.sum(F.when(ok, pages)).alias("pages"))


# Attributes that hold a sheet's number, those that surely do, and those that hold a title; names of blocks that are title blocks or details.
NUMBER_TAGS = "SHEET_NUMBER|图号|页号|DWGNO|NO|PAGE|SHEET|DRAWING_NO|图纸编号|图纸|SOUZAITU|SUOZAI|所在图"
SURE_TAGS = "SHEET_NUMBER|图号|页号|DRAWING_NO|图纸编号"
TITLE_TAGS = "DRAWING_TITLE|图名|标题|TITLE|NAME"
TITLE_BLOCKS = "图框|边框|幅面|图纸|标题栏|会签栏|签名栏|FRAME|FRM|BORDER|BORD|TITLE|TBAR|TB|SHEET|FORMAT|GB|国标"
DETAIL_BLOCKS = "大样|节点|DETAIL|CALL|CALLOUT|NOTE|局部|NOSING|标高|型材|SECTION|DET|局部放大|索引|放大|详图|节点详图|大样图|详图索引"


def sheet_numbers(attributes: DataFrame) -> DataFrame:
    """How many different sheets the title blocks of each file name, of a table of file, insert, block, tag and text.

    An inserted block counts if one of its tags is for a number and has a text, and it is a detail, or it is a title
    block by its name, by a tag for a title, or by a tag that surely is for a number. Numbers are told apart by their
    first four to six digits.
    """
    tagged = lambda tags: F.col("tag").rlike(f"(?i){tags}")
    numbers = F.collect_set(F.when(tagged(NUMBER_TAGS), sheet_code(F.nullif(F.trim("text"), F.lit("")))))
    per = attributes.groupBy("file", "insert", "block").agg(numbers.alias("codes"), F.bool_or(tagged(TITLE_TAGS) | tagged(SURE_TAGS)).alias("named"))
    counts = F.col("named") | F.col("block").rlike(f"(?i){DETAIL_BLOCKS}|{TITLE_BLOCKS}")
    return per.groupBy("file").agg(F.collect_set(F.when(counts, F.col("codes"))).alias("x")).select("file", F.size(F.array_distinct(F.flatten("x"))).cast("bigint").alias("sheets"))


#: Order lines as attributes: each order inserts a block into the file of its supplier.
ATTRIBUTES = "(SELECT l_suppkey AS file, l_orderkey AS insert_, list_extract(['A1 FRAME', 'Detail 3', 'X12', 'window', '图框'], CAST(l_orderkey % 5 + 1 AS INTEGER)) AS block, list_extract(['SCALE', 'NO', 'DRAWING_NO', 'Title', 'PAGE', 'BY', '页号'], CAST(l_linenumber AS INTEGER)) AS tag, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 't' || (l_partkey % 700 + 900) END AS text FROM lineitem)"


@query(f"SELECT file, count(DISTINCT code) FILTER (WHERE named OR regexp_matches(block, '(?i){DETAIL_BLOCKS}|{TITLE_BLOCKS}')) AS sheets FROM (SELECT *, CASE WHEN regexp_matches(tag, '(?i){NUMBER_TAGS}') THEN nullif(regexp_extract(upper(trim(text)), '\\d{{4,6}}'), '') END AS code, bool_or(regexp_matches(tag, '(?i){TITLE_TAGS}|{SURE_TAGS}')) OVER (PARTITION BY file, insert_, block) AS named FROM {ATTRIBUTES}) GROUP BY 1")
def e06_distinct_sheets(t: Tables) -> DataFrame:
    each = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int"))
    blocks, tags = ["A1 FRAME", "Detail 3", "X12", "window", "图框"], ["SCALE", "NO", "DRAWING_NO", "Title", "PAGE", "BY", "页号"]
    text = F.when(F.col("l_partkey") % 9 == 0, " ").otherwise(F.concat(F.lit("t"), F.col("l_partkey") % 700 + 900))
    return sheet_numbers(t.lineitem.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("insert"), each(blocks, F.col("l_orderkey") % 5 + 1).alias("block"), each(tags, F.col("l_linenumber")).alias("tag"), text.alias("text")))


@query("SELECT l_suppkey, count(DISTINCT (round_even(l_quantity / 8, 0), round_even(l_partkey / 256, 0))) AS cells FROM lineitem GROUP BY 1")
def e07_grid_cells(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct(F.struct(F.bround(F.col("l_quantity") / 8, 0), F.bround(F.col("l_partkey") / 256, 0))).alias("cells"))


@query(f"SELECT doc_id, CAST(len(x) AS BIGINT) AS cjk, CAST(len(list_distinct(x)) AS BIGINT) AS kinds FROM (SELECT doc_id, regexp_extract_all({T.HAN_SQL}, '[\\x{{4E00}}-\\x{{9FFF}}]') AS x FROM documents)")
def e08_han_diversity(t: Tables) -> DataFrame:
    x = F.regexp_extract_all(T.with_han(F.col("text")), F.lit(r"[\x{4E00}-\x{9FFF}]"), F.lit(0))
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", F.size("x").cast("bigint").alias("cjk"), F.size(F.array_distinct("x")).cast("bigint").alias("kinds"))


@query("SELECT l_suppkey, arg_max(bin, {'n': n, 'bin': bin}) AS height FROM (SELECT l_suppkey, CAST(floor(l_quantity / 6) * 6 AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def e09_dominant_height(t: Tables) -> DataFrame:
    bins = t.lineitem.groupBy("l_suppkey", (F.floor(F.col("l_quantity") / 6) * 6).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("l_suppkey").agg(F.max_by("bin", F.struct("n", "bin")).alias("height"))


TAGS = "list_extract(['EQ', 'INS', 'DEL', 'REP'], CAST(pos % 4 + 1 AS INTEGER))"


@query(f"SELECT doc_id, count(*) FILTER (WHERE tag = 'INS') AS n_ins, count(*) FILTER (WHERE tag = 'DEL') AS n_del, count(*) FILTER (WHERE tag = 'REP') AS n_rep, CAST(coalesce(sum(length(line)) FILTER (WHERE tag IN ('INS', 'REP')), 0) AS BIGINT) AS ins_chars, CAST(coalesce(sum(length(line)) FILTER (WHERE tag IN ('DEL', 'REP')), 0) AS BIGINT) AS del_chars FROM (SELECT *, {TAGS} AS tag FROM {LINES}) GROUP BY 1")
def e10_change_counts(t: Tables) -> DataFrame:
    ops = U.lines(t.documents).withColumn("tag", F.element_at(F.array(*map(F.lit, ["EQ", "INS", "DEL", "REP"])), F.col("pos") % 4 + 1))
    n = lambda *tags: F.count_if(F.col("tag").isin(*tags))
    size = lambda *tags: F.coalesce(F.sum(F.when(F.col("tag").isin(*tags), F.length("line"))), F.lit(0)).cast("bigint")
    return ops.groupBy("doc_id").agg(n("INS").alias("n_ins"), n("DEL").alias("n_del"), n("REP").alias("n_rep"), size("INS", "REP").alias("ins_chars"), size("DEL", "REP").alias("del_chars"))


@query(f"WITH s AS (SELECT doc_id, k, x, stop - length(x) AS start, stop FROM (SELECT doc_id, k, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (SELECT doc_id, unnest(range(len(xs))) AS k, unnest(xs) AS x FROM (SELECT doc_id, regexp_extract_all(text, '[^.\n]+[.\n]?|[.\n]') AS xs FROM documents))), r AS (SELECT doc_id, unnest([40, 300]) AS a FROM documents) SELECT doc_id, CAST(sum(n) AS BIGINT) AS orig_chars FROM (SELECT DISTINCT s.doc_id, k, {T.chars_sql('x')} AS n FROM s JOIN r ON s.doc_id = r.doc_id AND s.start < r.a + 30 AND s.stop > r.a) GROUP BY 1".replace("documents))), r AS", "documents)))), r AS"))
def e11_modified_sentences(t: Tables) -> DataFrame:
    each = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[^.\n]+[.\n]?|[.\n]"), F.lit(0))).alias("k", "x"))
    placed = U.with_offsets(each, ["doc_id"], "k", "x")
    ranges = t.documents.select("doc_id", F.explode(F.array(F.lit(40), F.lit(300))).alias("a"))
    hit = placed.join(ranges, "doc_id").where("start < a + 30 and stop > a").select("doc_id", "k", T.chars(F.col("x")).alias("n")).distinct()
    return hit.groupBy("doc_id").agg(F.sum("n").alias("orig_chars"))


@query(f"SELECT doc_id, line, CAST(min(pos) AS INTEGER) AS pos FROM {LINES} GROUP BY 1, 2")
def f01_line_dedup(t: Tables) -> DataFrame:
    return S.first_per_line(U.lines(t.documents), "doc_id")


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM {LINES} UNION ALL SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM {LINES} WHERE pos = 0")
def f02_keep_repeats(t: Tables) -> DataFrame:
    lines = U.lines(t.documents)
    return lines.unionAll(lines.where("pos = 0"))


FRAGMENTS = "(SELECT l_suppkey, list_distinct(list(l_returnflag || l_linestatus || l_linenumber || (l_partkey % 3))) AS x FROM lineitem GROUP BY 1)"


@query(f"SELECT a.l_suppkey AS a, b.l_suppkey AS b, len(a.x) AS na, len(b.x) AS nb FROM {FRAGMENTS} a JOIN {FRAGMENTS} b ON a.l_suppkey < b.l_suppkey AND 100 * len(list_intersect(a.x, b.x)) >= 97 * (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x)))")
def f05_same_objects(t: Tables) -> DataFrame:
    """Pairs of objects whose fragments agree by 97 % or more, with their sizes, of which the larger one counts."""
    pieces = t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus", "l_linenumber", F.col("l_partkey") % 3).alias("p")).distinct()
    return S.similar_sets(pieces, "l_suppkey", "p", 97).select("a", "b", F.col("na").cast("bigint").alias("na"), F.col("nb").cast("bigint").alias("nb"))


CELLS = "(SELECT l_suppkey AS book, l_orderkey AS sheet, l_linenumber AS row, l_returnflag || l_linestatus AS val FROM lineitem)"


@query(f"WITH c AS (SELECT DISTINCT book, sheet, row, val FROM {CELLS}), tops AS (SELECT book, sheet, arg_min(val, {{'r': row, 'v': val}}) AS val FROM c GROUP BY 1, 2), titles AS (SELECT book, val FROM tops GROUP BY 1, 2 HAVING count(*) >= 2), m AS (SELECT c.book, sheet, row, c.val, t.val IS NOT NULL AS title, row_number() OVER (PARTITION BY c.book, c.val ORDER BY sheet, row) AS n FROM c LEFT JOIN titles t ON c.book = t.book AND c.val = t.val) SELECT book, sheet, row, val FROM m WHERE NOT title OR n = 1")
def f06_collapse_titles(t: Tables) -> DataFrame:
    cells = t.lineitem.select(F.col("l_suppkey").alias("book"), F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), F.concat("l_returnflag", "l_linestatus").alias("val")).distinct()
    tops = cells.groupBy("book", "sheet").agg(F.min_by("val", F.struct("row", "val")).alias("val"))
    titles = tops.groupBy("book", "val").agg(F.count("*").alias("k")).where("k >= 2").select("book", "val")
    first = cells.join(titles, ["book", "val"], "left_semi").groupBy("book", "val").agg(F.min(F.struct("sheet", "row")).alias("at")).select("book", "at.sheet", "at.row", "val")
    return cells.join(titles, ["book", "val"], "left_anti").select("book", "sheet", "row", "val").unionByName(first)


RECTS = "(SELECT o_custkey AS file, o_orderkey AS id, CAST(o_orderkey % 40 AS DOUBLE) AS x0, CAST(o_orderkey % 30 AS DOUBLE) AS y0, o_orderkey % 40 + 10.0 + o_orderkey % 7 AS x1, o_orderkey % 30 + 10.0 + o_orderkey % 5 AS y1 FROM orders)"
HOLDS = "{0}.x0 - 5 <= {1}.x0 AND {0}.y0 - 5 <= {1}.y0 AND {1}.x1 <= {0}.x1 + 5 AND {1}.y1 <= {0}.y1 + 5"


def _rects(t: Tables) -> DataFrame:
    d = "CAST({} AS DOUBLE) AS {}"
    return t.orders.selectExpr("o_custkey AS file", "o_orderkey AS id", d.format("o_orderkey % 40", "x0"), d.format("o_orderkey % 30", "y0"), d.format("o_orderkey % 40 + 10 + o_orderkey % 7", "x1"), d.format("o_orderkey % 30 + 10 + o_orderkey % 5", "y1")).withColumn("area", F.expr("(x1 - x0) * (y1 - y0)"))


def _dropped(rects: DataFrame, inside: str) -> DataFrame:
    """Rectangles for which no larger one (of equal ones the earlier) of their file stands in the given relation."""
    return rects.join(S.held_rectangles(rects, inside), ["file", "id"], "left_anti")


AREAS = f"(SELECT *, (x1 - x0) * (y1 - y0) AS area FROM {RECTS})"
LARGER = "a.file = b.file AND (b.area > a.area OR (b.area = a.area AND b.id < a.id))"


@query(f"SELECT file, id FROM {AREAS} a WHERE NOT EXISTS (SELECT 1 FROM {AREAS} b WHERE {LARGER} AND {HOLDS.format('b', 'a')} AND {HOLDS.format('a', 'b')})")
def f07_same_rectangles(t: Tables) -> DataFrame:
    return _dropped(_rects(t), f"{HOLDS.format('b', 'a')} AND {HOLDS.format('a', 'b')}").select("file", "id")


@query(f"SELECT file, count(*) AS frames FROM {AREAS} a WHERE NOT EXISTS (SELECT 1 FROM {AREAS} b WHERE {LARGER} AND {HOLDS.format('b', 'a')}) GROUP BY 1")
def j03_maximal_frames(t: Tables) -> DataFrame:
    return _dropped(_rects(t), HOLDS.format("b", "a")).groupBy("file").agg(F.count("*").alias("frames"))


@query(f"SELECT DISTINCT doc_id, regexp_replace(lower(line), '{KEY_CLASS}', '', 'g') AS key FROM {LINES}")
def f09_unique_texts(t: Tables) -> DataFrame:
    return U.lines(t.documents).select("doc_id", line_key(F.col("line")).alias("key")).dropDuplicates()


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS last_type, max(event_id) AS event_id FROM events GROUP BY 1")
def f10_last_row_wins(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("event_id"))


# Pairs of documents: each even one as the original, the next as its revision.
PAIRED = f"(SELECT doc_id // 2 AS pair, doc_id % 2 AS side, pos, line AS text FROM {LINES} UNION ALL SELECT doc_id // 2, 1, 1000 + pos, line FROM {LINES} WHERE doc_id % 2 = 0 AND pos % 2 = 0)"


def _pairs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Revisions also hold every other line of their original, so that there is something to align."""
    lines = U.lines(t.documents).select(F.expr("doc_id div 2").alias("pair"), (F.col("doc_id") % 2).alias("side"), "pos", F.col("line").alias("text"))
    left, right = lines.where("side = 0").drop("side"), lines.where("side = 1").drop("side")
    return left, right.unionByName(left.where("pos % 2 = 0").withColumn("pos", F.col("pos") + 1000))


EQUAL_SQL = f"(SELECT o.pair, o.pos AS oi, r.pos AS rj FROM (SELECT *, row_number() OVER (PARTITION BY pair, text ORDER BY pos) AS nth FROM {PAIRED} WHERE side = 0) o JOIN (SELECT *, row_number() OVER (PARTITION BY pair, text ORDER BY pos) AS nth FROM {PAIRED} WHERE side = 1) r ON o.pair = r.pair AND o.text = r.text AND o.nth = r.nth)"


@query(f"SELECT pair, CAST(oi AS INTEGER) AS oi, CAST(rj AS INTEGER) AS rj FROM {EQUAL_SQL}")
def g01_equal_blocks(t: Tables) -> DataFrame:
    return S.match_equal(*_pairs(t), "pair")


def contained_in(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Each block's first document that contains it; none for a block without text.

    Words inside a block stand whole wherever it is contained, so the longest one of them is the key of an equi-join. Of
    two words the first ends a word of the document, and a single one is part of a word; so ends or parts of the
    documents' words of just the lengths that such blocks have are keys for them.
    """
    words = blocks.where("text <> ''").select("item_id", F.col("text").alias("part"), F.split("text", " ", -1).alias("w"))
    n = F.size("w")
    longest = F.array_max(F.transform(F.slice("w", F.lit(2), n - 2), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    kind = F.when(n >= 3, "word").when(n == 2, "end").otherwise("part")
    keyed = words.select("item_id", "part", kind.alias("kind"), F.when(n >= 3, longest).otherwise(F.get("w", F.lit(0))).alias("key"))
    lengths = {k: sorted(r["n"] for r in keyed.where(F.col("kind") == k).select(F.length("key").alias("n")).distinct().collect()) for k in ("end", "part")}
    word = documents.select("doc_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("key"))
    each = word.select("doc_id", F.lit("word").alias("kind"), "key")
    if lengths["end"]:
        ends = F.array_distinct(F.array(*[F.when(F.length("key") >= k, F.right("key", F.lit(k))) for k in lengths["end"]]))
        each = each.unionByName(word.select("doc_id", F.lit("end").alias("kind"), F.explode(ends).alias("key")).where("key is not null"))
    if lengths["part"]:
        parts = lambda k: F.when(F.length("key") >= k, F.transform(F.sequence(F.lit(1), F.length("key") - k + 1), lambda i: F.col("key").substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        each = each.unionByName(word.select("doc_id", F.lit("part").alias("kind"), F.explode(F.array_distinct(F.concat(*map(parts, lengths["part"])))).alias("key")))
    near = each.join(keyed, ["kind", "key"]).select("item_id", "part", "doc_id").distinct()
    found = documents.select("doc_id", "text").join(near, "doc_id").where(F.contains("text", "part"))
    return found.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def g02_contained_blocks(t: Tables) -> DataFrame:
    return contained_in(t.benchmark, t.documents)


LEFT_SQL = f"(SELECT p.* FROM {PAIRED} p LEFT JOIN {EQUAL_SQL} e ON p.pair = e.pair AND p.pos = CASE p.side WHEN 0 THEN e.oi ELSE e.rj END WHERE e.pair IS NULL)"


def _unmatched(t: Tables) -> tuple[DataFrame, DataFrame]:
    left, right = _pairs(t)
    equal = S.match_equal(left, right, "pair")
    return left.join(equal.select("pair", F.col("oi").alias("pos")), ["pair", "pos"], "left_anti"), right.join(equal.select("pair", F.col("rj").alias("pos")), ["pair", "pos"], "left_anti")


OVERLAPS = "list_max(list_filter(range(6, 31), lambda k: length(o.text) >= k AND length(r.text) >= k AND (o.text[-k:] = r.text[1:k] OR r.text[-k:] = o.text[1:k])))"


#: Unmatched blocks, and as further blocks of the revision those that begin with the end of every fifth block of the original.
NEAR_SQL = f"(SELECT pair, side, pos, text FROM {LEFT_SQL} UNION ALL SELECT pair, 1, pos + 1, right(text, 12) || ' qq' FROM {LEFT_SQL} WHERE side = 0 AND pos % 5 = 0 AND length(text) >= 12)"


@query(f"SELECT o.pair, CAST(o.pos AS INTEGER) AS oi, CAST(r.pos AS INTEGER) AS rj FROM {NEAR_SQL} o JOIN {NEAR_SQL} r ON o.pair = r.pair AND o.side = 0 AND r.side = 1 AND abs(o.pos - r.pos) <= 2 AND {OVERLAPS} >= 6")
def g04_near_overlaps(t: Tables) -> DataFrame:
    left, right = _unmatched(t)
    right = right.unionByName(left.where("pos % 5 = 0 and length(text) >= 12").select("pair", (F.col("pos") + 1).alias("pos"), F.concat(F.right("text", F.lit(12)), F.lit(" qq")).alias("text")))
    around = F.explode(F.sequence(F.col("pos") - 2, F.col("pos") + 2)).alias("rj")
    near = left.select("pair", F.col("pos").alias("oi"), F.col("text").alias("a"), around).join(right.select("pair", F.col("pos").alias("rj"), F.col("text").alias("b")), ["pair", "rj"])
    meets = F.exists(F.sequence(F.lit(6), F.lit(30)), lambda k: (F.length("a") >= k) & (F.length("b") >= k) & ((F.right("a", k) == F.left("b", k)) | (F.right("b", k) == F.left("a", k))))
    # what overlaps by six characters or more begins within the last thirty of the other
    begins = F.contains(F.right("a", F.lit(30)), F.left("b", F.lit(6))) | F.contains(F.right("b", F.lit(30)), F.left("a", F.lit(6)))
    return near.where(begins).where(meets).select("pair", "oi", "rj")


@query(f"SELECT pair, CASE side WHEN 0 THEN 'DEL' ELSE 'INS' END AS tag, CAST(pos AS INTEGER) AS pos, text FROM {LEFT_SQL}")
def g05_leftovers(t: Tables) -> DataFrame:
    left, right = _unmatched(t)
    return left.select("pair", F.lit("DEL").alias("tag"), "pos", "text").unionByName(right.select("pair", F.lit("INS").alias("tag"), "pos", "text"))


#: Nations as blocks: each is inserted into its region's root and once into the block five numbers before it; suppliers are their texts.
INSERTS = "(SELECT 'root' || n_regionkey AS parent, 'b' || n_nationkey AS child FROM nation UNION ALL SELECT 'b' || n_nationkey, 'b' || (n_nationkey + 5) FROM nation)"


@query(f"WITH RECURSIVE reach(root, block, depth) AS (SELECT parent, child, 1 FROM {INSERTS} WHERE parent LIKE 'root%' UNION ALL SELECT r.root, i.child, r.depth + 1 FROM reach r JOIN {INSERTS} i ON i.parent = r.block WHERE r.depth < 6) SELECT root, s_name AS text, count(*) AS n FROM reach JOIN supplier ON 'b' || s_nationkey = block GROUP BY 1, 2")
def g12_block_texts(t: Tables) -> DataFrame:
    block = F.concat(F.lit("b"), "n_nationkey")
    inserts = t.nation.select(F.concat(F.lit("root"), "n_regionkey").alias("parent"), block.alias("child"))
    inserts = inserts.unionByName(t.nation.select(block.alias("parent"), F.concat(F.lit("b"), F.col("n_nationkey") + 5).alias("child")))
    return S.expand_blocks(t.spark, inserts, t.supplier.select(F.concat(F.lit("b"), "s_nationkey").alias("block"), F.col("s_name").alias("text")))


@query("SELECT s_suppkey, n_name AS shared, r_name AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def g13_lookups(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("n_name").alias("shared"), F.col("r_name").alias("target"))


SPANS = "(SELECT l_suppkey AS g, CAST(l_partkey * 7 % 3000 AS BIGINT) AS s, CAST(l_partkey * 7 % 3000 + l_quantity AS BIGINT) AS e FROM lineitem)"
MERGED = f"(SELECT g, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= s THEN 0 ELSE 1 END AS new FROM {SPANS})) GROUP BY g, island)"


def _merged(t: Tables) -> DataFrame:
    spans = t.lineitem.selectExpr("l_suppkey AS g", "CAST(l_partkey * 7 % 3000 AS BIGINT) AS s", "CAST(l_partkey * 7 % 3000 + l_quantity AS BIGINT) AS e")
    return S.merge_intervals(spans, "g")


@query(f"SELECT g, s, e FROM {MERGED}")
def h03_merged_intervals(t: Tables) -> DataFrame:
    return _merged(t)


@query(f"SELECT g, e AS gap_start, nxt AS gap_stop FROM (SELECT *, lead(s) OVER (PARTITION BY g ORDER BY s) AS nxt FROM {MERGED}) WHERE nxt > e")
def h04_gaps(t: Tables) -> DataFrame:
    return S.gaps(_merged(t), "g")


RANKED = "(SELECT o_custkey AS g, o_totalprice AS area, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nxt FROM orders)"


def _ranked(t: Tables) -> DataFrame:
    down = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("g"), F.col("o_totalprice").alias("area"), F.row_number().over(down).alias("k"), F.lead("o_totalprice").over(down).alias("nxt"))


@query(f"SELECT g, min(k) AS cut FROM {RANKED} WHERE area / nxt >= 5 GROUP BY 1")
def h05_area_gap(t: Tables) -> DataFrame:
    return _ranked(t).where("area / nxt >= 5").groupBy("g").agg(F.min("k").cast("bigint").alias("cut"))


@query(f"SELECT g, CAST(CASE WHEN coalesce(area >= 3 * nxt, true) THEN 1 ELSE 2 END AS INTEGER) AS frames FROM {RANKED} WHERE k = 1")
def h06_dominant_frame(t: Tables) -> DataFrame:
    return _ranked(t).where("k = 1").select("g", F.when(F.coalesce(F.col("area") >= 3 * F.col("nxt"), F.lit(True)), 1).otherwise(2).alias("frames"))


#: Order lines as group codes: each order is a file, each line with number 1 begins a record.
PAIRS = "(SELECT l_suppkey AS file, l_orderkey * 10 + l_linenumber AS pos, CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '8' ELSE '3' END AS code, l_returnflag || l_partkey AS value FROM lineitem)"
NUMBERED = f"(SELECT *, sum(CASE WHEN code = '0' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos, value ROWS UNBOUNDED PRECEDING) AS entity FROM (SELECT DISTINCT ON (file, pos) * FROM (SELECT file, pos, min(code) AS code, min(value) AS value FROM {PAIRS} GROUP BY 1, 2)))"


def _entities(t: Tables) -> DataFrame:
    code = F.when(F.col("l_linenumber") == 1, "0").when(F.col("l_linenumber") == 2, "1").when(F.col("l_linenumber") == 3, "8").otherwise("3")
    pairs = t.lineitem.select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), code.alias("code"), F.concat("l_returnflag", "l_partkey").alias("value"))
    return S.entity_numbers(pairs.groupBy("file", "pos").agg(F.min("code").alias("code"), F.min("value").alias("value")), "file")


@query(f"SELECT file, pos, CAST(entity AS BIGINT) AS entity FROM {NUMBERED}")
def h07_entities(t: Tables) -> DataFrame:
    return _entities(t).select("file", "pos", "entity")


def _texts(t: Tables) -> DataFrame:
    own = F.collect_list(F.when(F.col("code").isin("1", "3"), F.struct("pos", "value")))
    return _entities(t).where("entity > 0").groupBy("file", "entity").agg(F.sort_array(own).alias("x")).where(F.size("x") > 0).select("file", "entity", F.array_join("x.value", "").alias("text"))


TEXTS = f"(SELECT file, CAST(entity AS BIGINT) AS entity, string_agg(value, '' ORDER BY pos) AS text FROM {NUMBERED} WHERE entity > 0 AND code IN ('1', '3') GROUP BY 1, 2)"


@query(f"SELECT * FROM {TEXTS}")
def a22_drawing_texts(t: Tables) -> DataFrame:
    return _texts(t)


@query(f"SELECT file, CAST(entity AS BIGINT) AS entity, coalesce(string_agg(value, '' ORDER BY pos) FILTER (WHERE code IN ('1', '3')), string_agg(value, '' ORDER BY pos) FILTER (WHERE code = '8')) AS text FROM {NUMBERED} WHERE entity > 0 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE code <> '0') > 0")
def o07_entity_texts(t: Tables) -> DataFrame:
    """Texts of dimensions: what is written over them, else what they measure, for which code 8 stands."""
    held = lambda *codes: F.array_join(F.sort_array(F.collect_list(F.when(F.col("code").isin(*codes), F.struct("pos", "value"))))["value"], "")
    per = _entities(t).where("entity > 0 and code <> '0'").groupBy("file", "entity").agg(held("1", "3").alias("written"), held("8").alias("measured"), F.count_if(F.col("code").isin("1", "3")).alias("n"))
    return per.select("file", "entity", F.when(F.col("n") > 0, F.col("written")).otherwise(F.col("measured")).alias("text"))


@query(f"SELECT file, text, min(entity) AS entity FROM {TEXTS} GROUP BY 1, 2")
def o04_drawing_dedup(t: Tables) -> DataFrame:
    return _texts(t).groupBy("file", "text").agg(F.min("entity").alias("entity"))


def repaired(pairs: DataFrame, by: str = "file") -> DataFrame:
    """Pairs of codes and values without the section of objects, and with the values of binary groups blank."""
    section = F.last(F.when(F.col("code") == "2", F.when(F.col("before") == "SECTION", F.col("value"))), ignorenulls=True)
    order = Window.partitionBy(by).orderBy("pos")
    inside = section.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = pairs.withColumn("before", F.lag("value").over(order)).withColumn("section", inside).where("coalesce(section, '') <> 'OBJECTS'")
    return named.select(by, "pos", "code", F.when(F.col("code").rlike("^31[0-9]$"), "").otherwise(F.col("value")).alias("value"))


#: Pairs in which every seventh record opens a section, every other one of them that of objects, and code 3 is binary.
BINARY = f"(SELECT file, pos, CASE WHEN sectioned AND code = '1' THEN '2' WHEN code = '3' THEN '31' || (pos % 10) ELSE code END AS code, CASE WHEN sectioned AND code = '0' THEN 'SECTION' WHEN sectioned AND code = '1' THEN CASE WHEN pos // 10 % 2 = 0 THEN 'OBJECTS' ELSE 'ENTITIES' END ELSE value END AS value FROM (SELECT *, pos // 10 % 7 = 0 AS sectioned FROM {NUMBERED}))"


@query(f"SELECT file, pos, code, CASE WHEN regexp_matches(code, '^31[0-9]$') THEN '' ELSE value END AS value FROM (SELECT *, last_value(CASE WHEN code = '2' AND before = 'SECTION' THEN value END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT *, lag(value) OVER (PARTITION BY file ORDER BY pos) AS before FROM {BINARY})) WHERE coalesce(section, '') <> 'OBJECTS'")
def a25_blank_binary(t: Tables) -> DataFrame:
    order, sectioned = F.expr("pos div 10"), F.expr("pos div 10 % 7 = 0")
    code = F.when(sectioned & (F.col("code") == "1"), "2").when(F.col("code") == "3", F.concat(F.lit("31"), F.col("pos") % 10)).otherwise(F.col("code"))
    value = F.when(sectioned & (F.col("code") == "0"), "SECTION").when(sectioned & (F.col("code") == "1"), F.when(order % 2 == 0, "OBJECTS").otherwise("ENTITIES")).otherwise(F.col("value"))
    return repaired(_entities(t).select("file", "pos", value.alias("value"), code.alias("code")))


#: Tags without contents. Fixed values.
VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
STEP = f"CASE WHEN starts_with(tag, '</') THEN -1 WHEN regexp_matches(tag, '^<(?:{VOID})\\b|/>$') THEN 0 ELSE 1 END"


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, tag, CAST(sum({STEP}) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM (SELECT page_id, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM (SELECT page_id, regexp_extract_all(html, '</?\\w[^>]*>') AS tags FROM pages))")
def h08_tag_depth(t: Tables) -> DataFrame:
    """How many tags are open after each tag of a page."""
    tags = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"</?\w[^>]*>"), F.lit(0))).alias("pos", "tag"))
    step = F.when(F.startswith("tag", F.lit("</")), -1).when(F.col("tag").rlike(rf"^<(?:{VOID})\b|/>$"), 0).otherwise(1)
    return tags.withColumn("depth", F.sum(step).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


@query("SELECT page_id, row_number() OVER (ORDER BY CAST(coalesce(nullif(regexp_extract(url, '\\d+'), ''), '0') AS BIGINT) % 1000000, page_id) AS place FROM pages")
def i01_numeric_order(t: Tables) -> DataFrame:
    number = F.coalesce(F.nullif(F.regexp_extract("url", r"\d+", 0), F.lit("")), F.lit("0")).cast("bigint") % 1_000_000
    return S.numbered(t.pages.select("page_id", number.alias("n")), F.col("n") * (1 << 43) + F.col("page_id"), "place").select("page_id", "place")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, k FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 20")
def i02_largest_first(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return t.lineitem.withColumn("k", k).where("k <= 20").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("k").cast("bigint").alias("k"))


@query("SELECT doc_id, text[1:1000] AS text FROM documents")
def i03_caps(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring("text", 1, 1000).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '…' ELSE text END AS label FROM conversations")
def i04_labels(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("…"))).otherwise(F.col("text")).alias("label"))


@query("SELECT l_orderkey AS poly, min(l_quantity) AS x0, min(l_partkey) AS y0, max(l_quantity) AS x1, max(l_partkey) AS y1 FROM lineitem GROUP BY 1 HAVING count(*) >= 4")
def j02_polyline_boxes(t: Tables) -> DataFrame:
    boxes = t.lineitem.groupBy(F.col("l_orderkey").alias("poly")).agg(F.min("l_quantity").alias("x0"), F.min("l_partkey").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_partkey").alias("y1"), F.count("*").alias("n"))
    return boxes.where("n >= 4").drop("n")


LADDER = "CASE WHEN a >= 2 THEN 'layouts' WHEN b > 0 THEN 'title blocks' WHEN c > 0 THEN 'frames' ELSE 'one' END"


@query(f"SELECT o_orderkey, CASE {LADDER} WHEN 'layouts' THEN a WHEN 'title blocks' THEN b WHEN 'frames' THEN c ELSE 1 END AS sheets, {LADDER} AS reason FROM (SELECT o_orderkey, o_orderkey % 4 AS a, o_custkey % 3 AS b, o_custkey % 5 AS c FROM orders)")
def j06_sheet_ladder(t: Tables) -> DataFrame:
    a, b, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 3, F.col("o_custkey") % 5
    return t.orders.select("o_orderkey", F.when(a >= 2, a).when(b > 0, b).when(c > 0, c).otherwise(1).cast("bigint").alias("sheets"), F.when(a >= 2, "layouts").when(b > 0, "title blocks").when(c > 0, "frames").otherwise("one").alias("reason"))


def tile_starts(size, tile: int = 1600, overlap: int = 150):
    """Where tiles begin along one side: every tile less overlap, and one that ends with the side."""
    last = F.greatest(F.lit(0), size - tile)
    return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last, F.lit(tile - overlap).cast("bigint")), F.array(last)))


STARTS = "list_distinct(list_concat(range(0, greatest(0, {0} - 1600) + 1, 1450), [greatest(0, {0} - 1600)]))"


@query(f"SELECT o_orderkey, unnest(xs) AS x, y FROM (SELECT o_orderkey, xs, unnest(ys) AS y FROM (SELECT o_orderkey, {STARTS.format('(o_orderkey % 5000)')} AS xs, {STARTS.format('(o_custkey % 7000)')} AS ys FROM orders))")
def k03_tiles(t: Tables) -> DataFrame:
    sides = t.orders.select("o_orderkey", tile_starts(F.col("o_orderkey") % 5000).alias("xs"), tile_starts(F.col("o_custkey") % 7000).alias("ys"))
    return sides.select("o_orderkey", "xs", F.explode("ys").alias("y")).select("o_orderkey", F.explode("xs").alias("x"), "y")


@query(f"SELECT doc_id, lines >= 3 AND words >= 20 AND longest >= 2 * shortest AS captured FROM (SELECT doc_id, count(*) AS lines, sum({T.count_sql('line', T.RUN)}) AS words, max(length(line)) AS longest, min(length(line)) AS shortest FROM {LINES} GROUP BY 1)")
def k06_body_captured(t: Tables) -> DataFrame:
    stats = U.lines(t.documents).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(T.nc(F.col("line"))).alias("words"), F.max(F.length("line")).alias("longest"), F.min(F.length("line")).alias("shortest"))
    return stats.selectExpr("doc_id", "lines >= 3 AND words >= 20 AND longest >= 2 * shortest AS captured")


@query(f"SELECT doc_id, '{{\"doc_id\":' || doc_id || ',\"fe\":' || fe || ',\"nc\":' || nc || ',\"chars\":' || chars || ',\"words\":' || words || '}}' AS json FROM {DOC_METRICS}")
def l04_json_results(t: Tables) -> DataFrame:
    return _metrics(t).select("doc_id", F.to_json(F.struct("doc_id", *T.TOTALS)).alias("json"))


@query("SELECT user_id, count(*) AS beats, min(ts) AS born, max(ts) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session")
def m02_liveness(t: Tables) -> DataFrame:
    beats = t.events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    grouped = beats.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("beats"), F.min("ts").alias("born"), F.max("ts").alias("last"))
    return grouped.drop("session_window")


def _journal(t: Tables) -> DataFrame:
    """Events as lines of a journal, a third of them added late; every hundredth is half-written."""
    line = F.to_json(F.struct(F.lit("progress").alias("type"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("rawResultJson"), (F.col("event_id") % 1000).cast("int").alias("done"), F.col("event_id").alias("t")))
    return t.events.select((F.col("event_id") % 3 == 0).cast("int").alias("late"), F.when(F.col("event_id") % 100 == 99, F.substring(line, 1, 15)).otherwise(line).alias("value"))


@query("SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS result, CAST(max(event_id % 1000) AS INTEGER) AS done FROM events WHERE event_id % 100 <> 99 GROUP BY 1")
def m01_journal_tail(t: Tables) -> DataFrame:
    """The last result of each id and the furthest progress, of a journal that a stream follows over two runs."""
    return latest_results(followed(_journal(t))).select("id", F.col("rawResultJson").alias("result"), "done")


@query("SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n FROM events WHERE event_id % 100 <> 99 GROUP BY 1")
def l08_appended_rows(t: Tables) -> DataFrame:
    """Rows of each id in the journal that the stream has written; none twice, none lost but the half-written ones."""
    return followed(_journal(t)).groupBy("id").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, s <> '' AS ok, CASE WHEN s = '' THEN 'blank' END AS error, {T.metrics_sql('s')} FROM (SELECT conv_id, turn, {T.stripped_sql("CASE WHEN turn = 2 THEN ' ' ELSE text END")} AS s FROM conversations)")
def o01_counted_with_errors(t: Tables) -> DataFrame:
    s = T.stripped(F.when(F.col("turn") == 2, " ").otherwise(F.col("text")))
    return t.conversations.select("conv_id", "turn", (s != "").alias("ok"), F.when(s == "", "blank").alias("error"), *T.metrics(s))


@query(f"SELECT doc_id, regexp_replace({T.HAN_SQL}, '[^{T.FAR}]', '', 'g') AS kept, ends_with({T.stripped_sql('text')}, '.') AS complete FROM documents")
def o10_far_east_only(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_replace(T.with_han(F.col("text")), f"[^{T.FAR}]", "").alias("kept"), F.endswith(T.stripped(F.col("text")), F.lit(".")).alias("complete"))


@query(f"SELECT source, arg_max(doc_id, {{'c': chars, 'd': doc_id}}) AS best, greatest(1, max(chars)) AS chars FROM {DOC_METRICS} GROUP BY 1")
def o15_best_engine(t: Tables) -> DataFrame:
    return _metrics(t).groupBy("source").agg(F.max_by("doc_id", F.struct("chars", "doc_id")).alias("best"), F.greatest(F.lit(1), F.max("chars")).alias("chars"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.page'), '') AS page, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def o16_typed_results(t: Tables) -> DataFrame:
    parsed = F.from_json("props", "page string, k string")
    return t.events.select("event_id", F.coalesce(parsed["page"], F.lit("")).alias("page"), F.coalesce(parsed["k"], F.lit("")).alias("k"))


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) AS BIGINT) AS start, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS stop FROM {LINES}")
def o24_run_offsets(t: Tables) -> DataFrame:
    return U.with_offsets(U.lines(t.documents), ["doc_id"], "pos", "line").select("doc_id", "pos", "start", "stop")


@query(f"SELECT conv_id, {T.metrics_sql('s')} FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS s FROM conversations GROUP BY 1)")
def o26_revised_total(t: Tables) -> DataFrame:
    whole = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.array_join("x.text", "\n").alias("s"))
    return whole.select("conv_id", *T.metrics(F.col("s")))


CLASSES = {"far_east": T.FAR, "drawing": T.DRAWING_CJK, "ocr": T.OCR_CJK, "ideograph": T.IDEOGRAPH}


@query("SELECT doc_id, " + ", ".join(f"{T.count_sql('x', f'[{v}]')} AS {k}" for k, v in CLASSES.items()) + " FROM (SELECT doc_id, translate(text, 'aeiou,', '中か、ア가Ａ') AS x FROM documents)")
def o35_character_classes(t: Tables) -> DataFrame:
    x = F.translate("text", "aeiou,", "中か、ア가Ａ")
    return t.documents.select("doc_id", *[T.count_of(x, f"[{v}]").alias(k) for k, v in CLASSES.items()])


@query("SELECT o_orderkey, x * 2.0 + 10 AS x, y * 2.0 - 5 AS y FROM (SELECT o_orderkey, CAST(o_orderkey % 97 AS DOUBLE) AS x, CAST(o_custkey % 89 AS DOUBLE) AS y FROM orders)")
def o43_transform(t: Tables) -> DataFrame:
    x, y = (F.col("o_orderkey") % 97).cast("double"), (F.col("o_custkey") % 89).cast("double")
    return t.orders.select("o_orderkey", (x * 2.0 + 10).alias("x"), (y * 2.0 - 5).alias("y"))


@query(f"SELECT doc_id, {EXT_SQL} AS ext FROM documents WHERE {EXT_SQL} <> 'xyz'")
def a01_collected_inputs(t: Tables) -> DataFrame:
    ext = some_ext(F.col("doc_id"))
    return t.documents.select("doc_id", ext.alias("ext")).where(ext != "xyz").dropDuplicates(["doc_id"])
