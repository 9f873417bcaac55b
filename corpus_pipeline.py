"""The corpus pipeline: five stages of operators, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.minhash import near_duplicates
from quillspan.llm.mixing import repeat_by_mix
from quillspan.llm.packing import pack_documents
from quillspan.llm.repetition import repetition_rules
from quillspan.llm.scratch import cut
from quillspan.llm.toxicity import classify_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain, fitted on the labels of the input, rejects go, each by its own text.

    A null or empty text is judged by the bias alone. Repeated rows are judged alike, rows with a null id or one id each
    for itself. Without documents or labels nothing goes. Further columns are handed on.
    """
    return classify_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True).where("kept").select("document.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text fails the base rules or repeats itself too much go.

    Null and empty texts go. Repeated rows, those with a null id and very long texts are judged like all others.
    """
    return repetition_rules(docs, carry=True).where("kept").select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row stays: that with the smallest id, null last; of rows with that id the first one stored.

    So of repeated rows one stays, whatever their ids. Rows without words all stay. Rows are stored once more with a
    number each, which stands for them here.
    """
    stored = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")), "numbered")
    found = near_duplicates(stored.select("row", "document.text"), id_col="row", width=5, percent=80)
    joined = cut(found.where("not kept").select(F.col("doc_id").alias("row"), F.col("component_id").alias("root")), "joined")
    members = joined.unionByName(joined.select(F.col("root").alias("row"), "root").distinct())
    named = cut(stored.select("row", F.col("document.doc_id").alias("id")).join(members, "row"), "members")
    stays = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row"))
    gone = cut(named.join(stays, "row", "left_anti").select("row"), "gone")
    return stored.join(gone, "row", "left_anti").select("document.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stand as often as the mix takes them. Null and empty texts have no words and are taken 0 to 3 times like others of their size; rows with one id and size draw alike."""
    return repeat_by_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequences; a null text is an empty one, repeated rows are packed as often, and a long text is cut into pieces."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Suffix arrays, signatures and packing have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
