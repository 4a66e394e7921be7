"""A training corpus from raw documents: each stage reads what the stage before it wrote.

Stages take (spark, docs, sf_dir) and return a frame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from starloom.llm import dart_minhash, decontaminate, line_rules, packing, skip_chain_pii
from starloom.llm.queries import with_library
from starloom.session import ensure_checkpoint_dir


def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines."""
    with_library(spark)
    return line_rules.cleaned_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id."""
    with_library(spark)
    return dart_minhash.deduplicated(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    with_library(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    with_library(spark)
    return skip_chain_pii.redacted_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document with its ids and its place in a training sequence."""
    with_library(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), name="packed_pieces")


STAGES = [
    ("quality_rules", cleaned),
    ("near_dedup", distinct),
    ("decontamination", unseen),
    ("pii", anonymous),
    ("packing", packed),
]

#: Tokens and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before it is read on."""
    with_library(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
