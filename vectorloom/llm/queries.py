"""The registered queries of the training-data operators and their DuckDB oracles.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import chat, click_dedup, cotraining, fingerprints, language_id, media, minmax_dedup, mixing, packing, page_text, spelling, suffix_dedup, token_counts
from vectorloom.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: Target shares of the sources of the documents table; all other sources share the rest.
WEIGHTS, OTHER_WEIGHT = {"src0": 0.10, "src1": 0.08, "src2": 0.08, "src3": 0.06, "src4": 0.06, "src5": 0.02}, 0.60

#: A conversation whose texts hold control strings, added to every run of the chat query.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)), presorted=True)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digest(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, OTHER_WEIGHT).select("doc_id", "source", "copy", "n_copies", "shuffle_key")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.store_texts(table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_click_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_dedup.dedup_clicks(table(spark, sf_dir, "clicks"))


def queries() -> dict[str, Query]:
    named = (op1_token_counts, op2_chat_format, op3_fingerprints, op4_suffix_dedup, op5_language_id, op6_packing, op7_minmax_dedup, op8_mixing, op9_media, op10_quality, op11_page_text, op12_spelling, op13_click_dedup)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.oracle_sql(WEIGHTS, OTHER_WEIGHT), "op12_spelling": spelling.oracle_sql()}
