"""Queries of frames in drawings, and of texts and images found in bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import sequences as S
from quillspan.operators.units import small_batches
from quillspan.plans.files import LINES_SQL, _counted, zipped
from quillspan.plans.grouping import LINES
from quillspan.plans.registry import Tables, query
from quillspan.sources import carving
from quillspan.sources.drawing import LEAST_COMMON, chosen_coding, recovered
from quillspan.sources.pdf import count_pages

# Snap and least size of frames, and how far one may reach out of another.
SNAP, LEAST_LINE, LEAST_SIDE, LEAST_AREA, MOST_RATIO, REACH = 2, 150, 150, 40_000, 10, 5

#: Order lines as drawing lines of a file: odd ones horizontal, even ones vertical, on a coarse grid.
DRAWN = """
SELECT l_suppkey AS file, l_linenumber % 2 = 1 AS flat,
  CASE WHEN l_linenumber % 2 = 1 THEN l_orderkey % 12 * 150 ELSE l_partkey % 9 * 200 END AS place,
  CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 5 * 200 ELSE l_orderkey % 8 * 150 END AS s,
  CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 5 * 200 + 200 * (l_linenumber % 4) ELSE l_orderkey % 8 * 150 + 301 + 150 * (l_orderkey % 5) END AS e
FROM lineitem"""


def frames_of_lines(drawn: DataFrame) -> DataFrame:
    """file, x0, y0, x1, y1 of the frames that long lines form, of a table of file, flat, place (y of flat lines, x of others), s and e.

    Coordinates are snapped and lines of one place merged. Two flat lines and two upright ones that span them make a
    frame; of frames within others only the largest stays (by area, then by place), if it is large enough and not too
    narrow. All joins are on file; the upright lines' also on their place.
    """
    snapped = [F.round(F.col(c) / SNAP).cast("bigint").alias(c) for c in ("place", "s", "e")]
    long = drawn.where(F.col("e") - F.col("s") >= LEAST_LINE).select("file", "flat", *snapped)
    merged = S.merge_intervals(long.select(F.struct("file", "flat", "place").alias("line"), "s", "e"), "line").select("line.*", "s", "e")
    flat = merged.where("flat").select("file", "place", "s", "e")
    upright = merged.where("not flat").select("file", F.col("place").alias("x"), (F.col("s") - 1).alias("from"), (F.col("e") + 1).alias("to"))
    between = flat.alias("a").join(flat.alias("b"), "file").where("b.place - a.place >= 100").select("file", F.greatest("a.s", "b.s").alias("x0"), F.col("a.place").alias("y0"), F.least("a.e", "b.e").alias("x1"), F.col("b.place").alias("y1")).where("x1 - x0 >= 100").distinct()
    spans = "{0}.file = r.file and {0}.x = r.{1} and {0}.from <= r.y0 and {0}.to >= r.y1"
    closed = between.alias("r").join(upright.alias("u"), F.expr(spans.format("u", "x0")), "left_semi").alias("r").join(upright.alias("w"), F.expr(spans.format("w", "x1")), "left_semi")
    rects = closed.select("file", *[(F.col(c) * SNAP).alias(c) for c in ("x0", "y0", "x1", "y1")]).withColumn("area", F.expr("(x1 - x0) * (y1 - y0)"))
    inside = f"o.file = r.file and o.x0 - {REACH} <= r.x0 and o.y0 - {REACH} <= r.y0 and r.x1 <= o.x1 + {REACH} and r.y1 <= o.y1 + {REACH} and (o.area > r.area or (o.area = r.area and struct(o.x0, o.y0) < struct(r.x0, r.y0)))"
    largest = rects.alias("r").join(rects.alias("o"), F.expr(inside), "left_anti")
    return largest.where(f"x1 - x0 >= {LEAST_SIDE} and y1 - y0 >= {LEAST_SIDE} and area >= {LEAST_AREA} and greatest(x1 - x0, y1 - y0) <= {MOST_RATIO} * least(x1 - x0, y1 - y0)").drop("area")


J01_SQL = f"""
WITH snapped AS (SELECT file, flat, CAST(round(place / {SNAP}) AS BIGINT) AS place, CAST(round(s / {SNAP}) AS BIGINT) AS s, CAST(round(e / {SNAP}) AS BIGINT) AS e FROM ({DRAWN}) WHERE e - s >= {LEAST_LINE}),
marked AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY file, flat, place ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= s THEN 0 ELSE 1 END AS new FROM snapped),
island AS (SELECT *, sum(new) OVER (PARTITION BY file, flat, place ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
merged AS (SELECT file, flat, place, min(s) AS s, max(e) AS e FROM island GROUP BY file, flat, place, k),
between_ AS (SELECT DISTINCT a.file, greatest(a.s, b.s) AS x0, a.place AS y0, least(a.e, b.e) AS x1, b.place AS y1 FROM merged a JOIN merged b ON a.file = b.file AND a.flat AND b.flat AND b.place - a.place >= 100 WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 100),
rects AS (SELECT file, x0 * {SNAP} AS x0, y0 * {SNAP} AS y0, x1 * {SNAP} AS x1, y1 * {SNAP} AS y1, (x1 - x0) * (y1 - y0) * {SNAP * SNAP} AS area FROM between_ r
  WHERE EXISTS (SELECT 1 FROM merged u WHERE NOT u.flat AND u.file = r.file AND u.place = r.x0 AND u.s - 1 <= r.y0 AND u.e + 1 >= r.y1) AND EXISTS (SELECT 1 FROM merged u WHERE NOT u.flat AND u.file = r.file AND u.place = r.x1 AND u.s - 1 <= r.y0 AND u.e + 1 >= r.y1))
SELECT file, x0, y0, x1, y1 FROM rects r WHERE x1 - x0 >= {LEAST_SIDE} AND y1 - y0 >= {LEAST_SIDE} AND area >= {LEAST_AREA} AND greatest(x1 - x0, y1 - y0) <= {MOST_RATIO} * least(x1 - x0, y1 - y0)
  AND NOT EXISTS (SELECT 1 FROM rects o WHERE o.file = r.file AND o.x0 - {REACH} <= r.x0 AND o.y0 - {REACH} <= r.y0 AND r.x1 <= o.x1 + {REACH} AND r.y1 <= o.y1 + {REACH} AND (o.area > r.area OR (o.area = r.area AND (o.x0 < r.x0 OR (o.x0 = r.x0 AND o.y0 < r.y0)))))"""


@query(J01_SQL)
def j01_line_frames(t: Tables) -> DataFrame:
    return frames_of_lines(t.spark.sql(DRAWN.replace("lineitem", "{lines}"), lines=t.lineitem))


#: Long sides over short ones of a sheet, about the square root of two, and how deep blocks may hold blocks. Fixed values.
SHEET, MOST_DEPTH = (1.30, 1.55), 4

#: Suppliers are rectangles of their nation's block; each nation's block holds that five numbers on at twice its size; customers are insertions.
RECTS = "(SELECT s_nationkey AS block, CAST(s_suppkey % 10 AS DOUBLE) AS x0, 0.0::DOUBLE AS y0, s_suppkey % 10 + 100.0::DOUBLE + s_suppkey % 60 AS x1, 100.0::DOUBLE AS y1 FROM supplier)"
HELD = "(SELECT n_nationkey AS block, n_nationkey + 5 AS child, 2.0::DOUBLE AS k, 3.0::DOUBLE AS dx, 1.0::DOUBLE AS dy FROM nation WHERE n_nationkey < 20)"
PLACED = "(SELECT c_custkey AS ins, c_nationkey AS block, 1.0::DOUBLE + c_custkey % 3 AS k, CAST(c_custkey % 100 AS DOUBLE) AS dx, CAST(c_custkey % 50 AS DOUBLE) AS dy, 90 * (c_custkey % 4) AS turn FROM customer)"
FRAME_SQL = f"""
WITH RECURSIVE reach(block, inner_, k, dx, dy, depth) AS (
  SELECT DISTINCT block, block, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM (SELECT n_nationkey AS block FROM nation)
  UNION ALL SELECT r.block, h.child, r.k * h.k, r.dx + r.k * h.dx, r.dy + r.k * h.dy, r.depth + 1 FROM reach r JOIN {HELD} h ON h.block = r.inner_ WHERE r.depth < {MOST_DEPTH}),
own AS (SELECT r.block, x0 * k + dx AS x0, y0 * k + dy AS y0, x1 * k + dx AS x1, y1 * k + dy AS y1 FROM reach r JOIN {RECTS} q ON q.block = r.inner_),
best AS (SELECT block, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY (x1 - x0) * (y1 - y0) DESC, x0, y0) AS nth FROM own) WHERE nth = 1)
SELECT ins, x0 * k + dx AS x0, y0 * k + dy AS y0, x1 * k + dx AS x1, y1 * k + dy AS y1 FROM best JOIN {PLACED} p USING (block)
WHERE turn = 0 AND greatest(x1 - x0, y1 - y0) BETWEEN {SHEET[0]} * least(x1 - x0, y1 - y0) AND {SHEET[1]} * least(x1 - x0, y1 - y0)"""


def block_frames(rects: DataFrame, held: DataFrame, placed: DataFrame) -> DataFrame:
    """ins and the rectangle of each insertion whose block's largest rectangle has a sheet's ratio.

    rects: block, x0, y0, x1, y1; held: block, child, k (scale), dx, dy of blocks in blocks; placed: ins, block, k, dx,
    dy and turn of the insertions, of which turned ones are left out. Rectangles of inner blocks count as far as MOST_DEPTH. Blocks are joined
    level by level, so nothing recursive is planned.
    """
    moved = lambda c, d: F.col(c) * F.col("k") + F.col(d)
    corners = [("x0", "dx"), ("y0", "dy"), ("x1", "dx"), ("y1", "dy")]
    area = F.expr("(x1 - x0) * (y1 - y0)")
    # of each block the largest of its own and inner rectangles; a level adds one more depth
    largest = lambda df: df.groupBy("block").agg(F.max_by(F.struct("x0", "y0", "x1", "y1"), F.struct(area, -F.col("x0"), -F.col("y0"))).alias("r")).select("block", "r.*")
    own = largest(rects)
    best = own
    for _ in range(MOST_DEPTH):
        inner = held.join(best.withColumnRenamed("block", "child"), "child").select("block", *[moved(c, d).alias(c) for c, d in corners])
        best = largest(own.unionByName(inner))
    ratio = F.expr(f"greatest(x1 - x0, y1 - y0) BETWEEN {SHEET[0]}D * least(x1 - x0, y1 - y0) AND {SHEET[1]}D * least(x1 - x0, y1 - y0)")
    return placed.where("turn = 0").join(best.where(ratio), "block").select("ins", *[moved(c, d).alias(c) for c, d in corners])


@query(FRAME_SQL)
def j04_block_frames(t: Tables) -> DataFrame:
    some = lambda sql, **tables: t.spark.sql(sql[1:-1].replace("::DOUBLE", "D").replace("supplier", "{supplier}").replace("nation WHERE", "{nation} WHERE").replace("FROM customer", "FROM {customer}"), **tables)
    return block_frames(some(RECTS, supplier=t.supplier), some(HELD, nation=t.nation), some(PLACED, customer=t.customer))


def _per_document(t: Tables, made, kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Rows that a function makes of each document's id and text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for r in made(i, text.as_py() or "")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    small_batches(t.spark)
    return t.documents.select("doc_id", "text").mapInArrow(each, schema)


def _with_han(text: str) -> str:
    return text.translate(str.maketrans("aeiou", "中文字数统"))


STRICT = T.HAN + r"\x{20000}-\x{2FFFF}"
RUNS = r"[ -~" + STRICT + r"\x{FF01}-\x{FF5E}\x{3000}-\x{303F}\x{2014}-\x{201D}\x{2026}\x{2027}\x{B7}]{4,}"


@query(f"SELECT DISTINCT doc_id, trim(x, ' ') AS run FROM (SELECT doc_id, unnest(regexp_extract_all({T.HAN_SQL.replace('text', "regexp_replace(text, '[bcdfghlmnpst]', '', 'g')")}, '{RUNS}')) AS x FROM documents) WHERE {T.count_sql('x', f'[{STRICT}]')} >= {carving.UTF16_SHARE} * length(x) AND trim(x, ' ') <> ''")
def h02_utf16_runs(t: Tables) -> DataFrame:
    """Texts without most consonants, so that Han characters in place of vowels are the most."""
    made = lambda i, text: [(i, run) for run in carving.utf16_runs(_with_han(text.translate({ord(c): None for c in "bcdfghlmnpst"})).encode("utf-16-le"))]
    return _per_document(t, made, {"doc_id": pa.int64(), "run": pa.string()}, "doc_id bigint, run string")


@query()
def h01_gbk_runs(t: Tables) -> DataFrame:
    made = lambda i, text: [(i, run) for run in carving.gbk_runs(bytes(8) + _with_han(text).encode("gbk", "ignore"))]
    return _per_document(t, made, {"doc_id": pa.int64(), "run": pa.string()}, "doc_id bigint, run string")


@query()
def a27_carved_texts(t: Tables) -> DataFrame:
    made = lambda i, text: [(i, u["kind"], u["text"]) for u in carving.carved_units(bytes(8) + (_with_han(text).encode("utf-16-le") if i % 2 else text.encode()))]
    return _per_document(t, made, {"doc_id": pa.int64(), "kind": pa.string(), "text": pa.string()}, "doc_id bigint, kind string, text string")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND {T.count_sql(T.HAN_SQL, f'[{T.HAN}]')} > 0 THEN 'GB18030' ELSE 'UTF-8' END AS coding FROM documents")
def e12_coding_vote(t: Tables) -> DataFrame:
    """Even documents in GB18030, odd ones in UTF-8, without accented letters, which read like Chinese in the other coding."""
    made = lambda i, text: [(i, chosen_coding(_with_han(text.encode("ascii", "ignore").decode()).encode("utf-8" if i % 2 else "gb18030")))]
    return _per_document(t, made, {"doc_id": pa.int64(), "coding": pa.string()}, "doc_id bigint, coding string")


PLAIN_HAN = T.HAN_SQL.replace("text", "regexp_replace(text, '[^\\x{00}-\\x{7F}]', '', 'g')")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND {T.count_sql(PLAIN_HAN, '中')} >= {LEAST_COMMON} THEN {PLAIN_HAN} END AS recovered FROM documents")
def o08_recovered(t: Tables) -> DataFrame:
    """Even documents in GB18030 that was read as Latin-1; of the characters put in, one is frequent."""
    plain = lambda text: text.encode("ascii", "ignore").decode()
    made = lambda i, text: [(i, recovered(plain(text) if i % 2 else _with_han(plain(text)).encode("gb18030").decode("latin-1")))]
    return _per_document(t, made, {"doc_id": pa.int64(), "recovered": pa.string()}, "doc_id bigint, recovered string")


def unseen_fragments(body: str, fragments: list[str]) -> list[str]:
    """Fragments that, without white space, occur neither in the body nor in those taken before."""
    seen, out = "".join(body.split()), []
    for fragment in fragments:
        bare = "".join(fragment.split())
        if bare and bare not in seen:
            seen += bare
            out.append(fragment.strip())
    return out


@query()
def f08_unseen_fragments(t: Tables) -> DataFrame:
    """A document's first half is the body, the lines of the whole the fragments."""
    made = lambda i, text: [(i, k, s) for k, s in enumerate(unseen_fragments(text[: len(text) // 2], text.split("\n")))]
    return _per_document(t, made, {"doc_id": pa.int64(), "k": pa.int32(), "fragment": pa.string()}, "doc_id bigint, k int, fragment string")


@query(LINES_SQL)
def a08_pdf(t: Tables) -> DataFrame:
    return _counted(t, "pdf")


@query(f"SELECT doc_id, greatest(1, CAST(ceil(count(line) / 40) AS BIGINT)) AS pages FROM documents LEFT JOIN {LINES} USING (doc_id) GROUP BY 1")
def o12_pdf_pages(t: Tables) -> DataFrame:
    from quillspan.plans.files import built_file

    made = lambda i, text: [(i, count_pages(built_file("pdf", [s.strip() for s in text.split("\n") if s.strip()])))]
    return _per_document(t, made, {"doc_id": pa.int64(), "pages": pa.int64()}, "doc_id bigint, pages bigint")


HEADS = "CASE " + " ".join(f"WHEN starts_with(h, '{v}') THEN '{k}'" for k, v in carving.IMAGE_HEADS.items()) + " END"


@query(f"SELECT event_id, {HEADS} AS kind FROM (SELECT event_id, list_extract(['89504E470D0A1A0A00', 'FFD8FFE0', '424D3600', '47494638', '0011', ''], CAST(event_id % 6 + 1 AS INTEGER)) AS h FROM events)")
def o36_image_kinds(t: Tables) -> DataFrame:
    heads = F.array(*map(F.lit, ["89504E470D0A1A0A00", "FFD8FFE0", "424D3600", "47494638", "0011", ""]))
    return t.events.select("event_id", carving.image_kind(F.unhex(F.element_at(heads, (F.col("event_id") % 6 + 1).cast("int")))).alias("kind"))


@query("SELECT doc_id || '.docx' AS path, 'word/media/image' || k || '.x' AS name, CASE k WHEN 0 THEN 'gif' END AS kind, CAST(4 + k AS BIGINT) AS size FROM documents, (SELECT unnest([0, 1]) AS k) WHERE k < doc_id % 3")
def a31_media(t: Tables) -> DataFrame:
    made = lambda i, text: [(f"{i}.docx", zipped({"word/document.xml": "<d/>"} | {f"word/media/image{k}.x": "GIF8" if k == 0 else "plain" for k in range(i % 3)}))]
    return carving.media_of_files(_per_document(t, made, {"path": pa.string(), "content": pa.binary()}, "path string, content binary"))


#: Least and most milliseconds for one file. Fixed values.
FLOOR_MS, MOST_MS = 20_000, 600_000


@query(f"SELECT o_orderkey, CAST(greatest({FLOOR_MS}, least({MOST_MS}, (o_custkey * 1000) // greatest(1, o_orderkey % 5))) AS BIGINT) AS budget, CAST(greatest(0, o_custkey * 1000 - {FLOOR_MS} * greatest(1, o_orderkey % 5)) AS BIGINT) AS spare FROM orders")
def m06_budget(t: Tables) -> DataFrame:
    """What remains of a batch's time for each file that waits, and what may go to stages that can be left out."""
    return t.orders.selectExpr("o_orderkey", f"CAST(greatest({FLOOR_MS}, least({MOST_MS}, (o_custkey * 1000) DIV greatest(1, o_orderkey % 5))) AS BIGINT) AS budget", f"CAST(greatest(0, o_custkey * 1000 - {FLOOR_MS} * greatest(1, o_orderkey % 5)) AS BIGINT) AS spare")


@query(f"SELECT doc_id, '# ' || doc_id || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) || '| ' || CAST(sum(fe) AS BIGINT) || ' | ' || CAST(sum(nc) AS BIGINT) || ' | ' || CAST(sum(chars) AS BIGINT) || ' | ' || CAST(sum(words) AS BIGINT) || ' |' AS report FROM (SELECT doc_id, pos, line, {T.metrics_sql('line')} FROM {LINES}) GROUP BY 1")
def l01_file_report(t: Tables) -> DataFrame:
    """A file's report in Markdown: its units and their totals."""
    from quillspan.operators.units import lines

    each = lines(t.documents).select("doc_id", "pos", "line", *T.metrics(F.col("line")))
    per = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("x"), *T.totals())
    total = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(m).cast("string") for m in T.TOTALS]), F.lit(" |"))
    return per.select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("doc_id")), F.array_join("x.line", "\n\n"), total).alias("report"))
