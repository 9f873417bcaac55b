"""Queries of two versions of a document: order, differences, regions and tracked changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators import diff as D
from quillspan.operators.units import small_batches
from quillspan.plans.grouping import PAIRED, _pairs
from quillspan.plans.registry import Tables, query


def per_pair(original: DataFrame, revised: DataFrame, rows: Callable[[list[str], list[str]], list[tuple]], schema: str) -> DataFrame:
    """Rows that a function makes of the blocks of both versions, with the pair first. A pair's blocks meet in one task, as one document's do."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        pair = int((a if len(a) else b)["pair"].iloc[0])
        found = rows(a.sort_values("pos")["text"].tolist(), b.sort_values("pos")["text"].tolist())
        out = pd.DataFrame([(pair, *r) for r in found], columns=names)
        return out.astype({n: "Int32" for n, kind in (c.split() for c in schema.split(", ")) if kind == "int"})

    return original.groupBy("pair").cogroup(revised.groupBy("pair")).applyInPandas(each, schema)


@query()
def g06_document_order(t: Tables) -> DataFrame:
    def rows(a: list[str], b: list[str]) -> list[tuple]:
        return [(k, *op) for k, op in enumerate(D.in_document_order(D.align(a, b)))]

    return per_pair(*_pairs(t), rows, "pair bigint, seq int, tag string, oi int, rj int")


@query()
def g07_paragraph_diff(t: Tables) -> DataFrame:
    def rows(a: list[str], b: list[str]) -> list[tuple]:
        return [(k, *op) for k, op in enumerate(D.fused_opcodes(a, b))]

    return per_pair(*_pairs(t), rows, "pair bigint, seq int, tag string, i1 int, i2 int, j1 int, j2 int")


def _beside(t: Tables) -> DataFrame:
    """Blocks of both versions at one place."""
    left, right = _pairs(t)
    return left.join(right.withColumnRenamed("text", "other"), ["pair", "pos"])


def per_row(beside: DataFrame, rows: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    """Rows that a function makes of both texts of each row, with the pair and place first."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(pair, pos, *r) for pair, pos, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows(a or "", b or "")]
            columns = list(zip(*found, strict=True)) if found else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    small_batches(beside.sparkSession)
    return beside.select("pair", "pos", "text", "other").mapInArrow(each, schema)


@query()
def g08_inline_runs(t: Tables) -> DataFrame:
    return per_row(_beside(t), lambda a, b: [(k, *op) for k, op in enumerate(D.inline_ops(a, b))], "pair bigint, pos int, seq int, tag string, i1 int, i2 int, j1 int, j2 int")


@query()
def g09_common_runs(t: Tables) -> DataFrame:
    return per_row(_beside(t), lambda a, b: [(k, *run) for k, run in enumerate(D.diff_runs(a, b))], "pair bigint, pos int, seq int, same boolean, old string, new string")


@query()
def g10_row_runs(t: Tables) -> DataFrame:
    """Lines stand for table rows, and what lies between commas for cells."""
    return per_row(_beside(t), lambda a, b: [(k, *run) for k, run in enumerate(D.row_runs(a.split(","), b.split(",")))], "pair bigint, pos int, seq int, cell int, same boolean, old string, new string")


KINDS = ["header", "footnote", "textbox", "field"]
REGION_SQL = f"(SELECT pair, side, list_extract({KINDS}, CAST(pos % 4 + 1 AS INTEGER)) AS kind, string_agg(text, chr(10) ORDER BY pos) AS text FROM {PAIRED} GROUP BY 1, 2, 3)"


def compared_regions(original: DataFrame, revised: DataFrame) -> DataFrame:
    """pair, kind and what happened to it (same, changed, added, removed) for the regions of two tables of pair, kind and text."""
    both = original.withColumn("there", F.lit(True)).join(revised.select("pair", "kind", F.col("text").alias("other"), F.lit(True).alias("here")), ["pair", "kind"], "full")
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "removed").when(F.col("text").eqNullSafe(F.col("other")), "same").otherwise("changed")
    return both.select("pair", "kind", change.alias("change"))


@query(f"SELECT coalesce(o.pair, r.pair) AS pair, coalesce(o.kind, r.kind) AS kind, CASE WHEN o.pair IS NULL THEN 'added' WHEN r.pair IS NULL THEN 'removed' WHEN o.text IS NOT DISTINCT FROM r.text THEN 'same' ELSE 'changed' END AS change FROM (SELECT * FROM {REGION_SQL} WHERE side = 0) o FULL JOIN (SELECT * FROM {REGION_SQL} WHERE side = 1) r ON o.pair = r.pair AND o.kind = r.kind")
def g11_regions(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("pos") % 4 + 1).cast("int"))
    joined = lambda df: df.groupBy("pair", kind.alias("kind")).agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x")).select("pair", "kind", F.array_join("x.text", "\n").alias("text"))
    return compared_regions(*map(joined, _pairs(t)))


@query()
def l06_tracked_changes(t: Tables) -> DataFrame:
    return per_pair(*_pairs(t), lambda a, b: [(D.tracked_body(a, b, "quillspan", "2020-01-01T00:00:00Z"),)], "pair bigint, body string")


@query()
def o25_tracked_paragraphs(t: Tables) -> DataFrame:
    return per_row(_beside(t), lambda a, b: [(D.tracked_paragraph(D.diff_runs(a, b), "quillspan", "2020-01-01T00:00:00Z", 1),)], "pair bigint, pos int, xml string")


#: Characters that XML 1.0 forbids, as far as texts here may hold them.
FORBIDDEN = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{FFFE}\x{FFFF}]"
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}


def xml_text(c: Column) -> Column:
    """Text for XML 1.0, as column functions."""
    out = F.regexp_replace(c, FORBIDDEN, "")
    for plain, entity in ENTITIES.items():
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


@query("SELECT page_id, " + "replace(" * 4 + f"regexp_replace(html || chr(7), '{FORBIDDEN}', '', 'g')" + "".join(f", '{a}', '{b}')" for a, b in ENTITIES.items()) + " AS xml FROM pages")
def o28_xml_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", xml_text(F.concat("html", F.lit("\x07"))).alias("xml"))
