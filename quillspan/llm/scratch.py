"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ARROW_ROWS = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: a temporary one in local mode, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if spark.sparkContext.master.startswith("local["):
            found = "file://" + tempfile.mkdtemp(prefix="quillspan-")
            atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: no executor's loss costs more than a file's re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quillspan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Few rows for each Arrow batch, as a row may hold a very long text. The session keeps the setting, as plans read it when they run; a smaller one stays."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def clear(spark: SparkSession) -> None:
    """Deletes all tables that cut has stored in the shared folder. For when results are written; what isn't yet would miss them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/quillspan")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def over_texts(documents: DataFrame, measure: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: str, *, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """What measure makes of each row's text, beside the row's id or, if carry, beside document, a struct of all its columns, so that verdicts belong to rows whatever their ids. measure hands on the first column of what it gets as it is."""
    short_batches(documents.sparkSession)
    if not carry:
        return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(measure, f"doc_id bigint, {fields}")
    names, at = ["document", *StructType.fromDDL(fields).names], documents.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(at)], ["document", "text"]) for b in batches)
        for out in measure(split):
            yield pa.RecordBatch.from_arrays(out.columns, names)

    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"))
    return rows.mapInArrow(each, StructType([StructField("document", documents.schema), *StructType.fromDDL(fields).fields]))
