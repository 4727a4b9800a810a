"""Corpus pipeline: language ID, near-dedup, suffix-array dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the last
return the columns of documents; the last returns the packed pieces. Stages that use Python set the session to small
Arrow batches, as their executors' workers and buffers stay beside a heap that has grown in the stages before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import language_id, minmax_dedup, mixing, packing, suffix_dedup
from vectorloom.llm.memory import small_batches
from vectorloom.llm.queries import OTHER_WEIGHT, WEIGHTS
from vectorloom.session import remove, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, not typical of any learned language, or told apart by little more than a guess, go."""
    small_batches(spark)
    return language_id.accept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    small_batches(spark)
    return minmax_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and strings of 400 bytes, that occur twice are cut out of the texts."""
    small_batches(spark)
    return suffix_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the sources' target weights and shuffled."""
    return mixing.mix(docs, WEIGHTS, OTHER_WEIGHT).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages use a trained network, a similarity search and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again.

    A stage's table is deleted when the next one is written; the last stays, as the result is read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
