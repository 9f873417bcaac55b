"""The queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.chat import CHAT_SQL, format_chats
from quillspan.llm.langid import identify_languages
from quillspan.llm.licenses import scan_licenses, scan_sql
from quillspan.llm.media import media_columns
from quillspan.llm.minhash import NEAR_SQL, near_duplicates
from quillspan.llm.mixing import mix_sources, mix_sql
from quillspan.llm.packing import pack_documents
from quillspan.llm.repetition import repetition_rules
from quillspan.llm.tokencount import token_counts
from quillspan.llm.toxicity import classify_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def op4_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_maximal_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).withColumn("feature", F.lower(F.hex("phash"))).drop("phash")


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity_chain, op2_minhash_coordinates, op3_suffix_repetition, op4_license_dice, op5_maximal_chats, op6_sum_of_squares_packing, op7_hyperdimensional_language, op8_token_counts, op9_png_media, op10_pareto_mix)}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_coordinates": NEAR_SQL, "op10_pareto_mix": mix_sql(), "op4_license_dice": scan_sql(), "op5_maximal_chats": CHAT_SQL}
