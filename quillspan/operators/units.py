"""Text units: lines, paragraphs, sentences, tokens and cells, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T


#: Bytes after which an Arrow batch ends, so that what a function makes of a batch stays small too.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Few bytes for each Arrow batch. The session keeps the setting, as plans read it when they run; a smaller one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos and line of each line that isn't blank, stripped. Null texts have none."""
    each = df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    return each.withColumn("line", T.stripped(F.col("line"))).where("line <> ''")


LINES_SQL = f"(SELECT doc_id, pos, {T.stripped_sql('raw')} AS line FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents) WHERE {T.stripped_sql('raw')} <> '')"


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos and text of each paragraph, between blank lines."""
    return df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), f"\n[{T.WS}]*\n", -1)).alias("pos", "text"))


def count_units(units: DataFrame, by: list[str], unit: str) -> DataFrame:
    """Metrics of units, summed for each group."""
    return units.select(*by, *T.metrics(F.coalesce(F.col(unit), F.lit("")))).groupBy(*by).agg(*T.totals())


def selected_units(units: DataFrame, sheet: str = "all", with_notes: bool = False) -> DataFrame:
    """Units of files that count: neither failed nor hidden, notes only if asked for, and of workbooks all sheets, the first shown one, or that of a name."""
    kept = units.where(F.col("ok") & (F.col("kind") == "note") & F.lit(with_notes) | F.col("ok") & ~F.coalesce(F.col("hidden"), F.lit(False)))
    if sheet == "all":
        return kept
    cells = (F.col("kind") == "cell") & F.col("sheet").isNotNull()
    if sheet == "first":
        first = kept.where(cells).groupBy("path", "member").agg(F.min_by("sheet", "seq").alias("_first"))
        return kept.join(first, ["path", "member"], "left").where(~cells | (F.col("sheet") == F.col("_first"))).drop("_first")
    return kept.where(~cells | (F.col("sheet") == sheet))


#: Ends of sentences in the two splitters. Fixed values.
SHORT_ENDS, LONG_ENDS = "。！？；\n\r", "。！？；…\n\r.!?;:"


def sentences(c: Column, ends: str = SHORT_ENDS) -> Column:
    """A text's sentences, each with its end, in order; those of white space alone are left out."""
    return F.filter(F.regexp_extract_all(c, F.lit(f"[^{ends}]+[{ends}]?|[{ends}]"), F.lit(0)), lambda s: T.stripped(s) != "")


def sentences_sql(x: str, ends: str = SHORT_ENDS) -> str:
    return f"list_filter(regexp_extract_all({x}, '[^{ends}]+[{ends}]?|[{ends}]'), lambda s: {T.stripped_sql('s')} <> '')"


TOKEN = f"[{T.HAN}]|[\\p{{L}}\\p{{N}}_&&[^{T.HAN}]]+|(?s)."


def tokens(c: Column) -> Column:
    """Tokens for a comparison: each Han character, each run of other letters, digits and _, and each other character."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def with_offsets(df: DataFrame, by: list[str], order: str, piece: str) -> DataFrame:
    """Where each piece starts and ends in its group's joined text."""
    running = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("stop", F.sum(F.length(piece)).over(running)).withColumn("start", F.col("stop") - F.length(piece))


def harvest_tags(c: Column) -> Column:
    """Stripped texts between tags that aren't empty."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(">([^<>]+)<"), F.lit(1)), T.stripped), lambda s: s != "")


HARVEST_SQL = f"list_filter(list_transform(regexp_extract_all(html, '>([^<>]+)<', 1), lambda s: {T.stripped_sql('s')}), lambda s: s <> '')"
