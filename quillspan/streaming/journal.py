"""The results journal as a stream: JSON lines that are added to, read from where the last run ended."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "type string, id string, displayName string, error string, rawResultJson string, name string, done int, total int, t bigint"


def read_journal(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a folder's journal files; half-written lines are dropped."""
    lines = spark.readStream.schema("value string").text(folder)
    return lines.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where("id is not null or type is not null")


def latest_results(rows: DataFrame) -> DataFrame:
    """Of each id the row that came last, and the furthest progress."""
    return rows.where("id is not null").groupBy("id").agg(F.max_by("rawResultJson", "t").alias("rawResultJson"), F.max_by("error", "t").alias("error"), F.max("done").alias("done"))


def beats(rows: DataFrame, gap: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """Spans in which heartbeats came without a longer gap; rows later than late are dropped."""
    timed = rows.where("type = 'svc_heartbeat'").withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "name").agg(F.count("*").alias("beats"))


def append_journal(rows: DataFrame, folder: str, checkpoint: str):
    """Adds a stream's rows as JSON lines."""
    return rows.writeStream.format("json").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, else below the warehouse; in local mode a temporary one, which goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found and spark.sparkContext.master.startswith("local["):
        found = tempfile.mkdtemp(prefix="quillspan-journal-")
        atexit.register(shutil.rmtree, found, True)
    return f"{(found or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/quillspan/journal-{uuid.uuid4().hex}"


def followed(journal: DataFrame) -> DataFrame:
    """The rows of a table of JSON lines (value), after they went through two runs of a stream that adds to a journal: the second run takes up what was added after the first."""
    spark = journal.sparkSession
    folder = work_folder(spark)
    for half in (F.col("late") == 0, F.col("late") == 1):
        journal.where(half).select("value").write.mode("append").text(f"{folder}/in")
        append_journal(read_journal(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SCHEMA).json(f"{folder}/out")
