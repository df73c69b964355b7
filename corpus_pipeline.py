"""A corpus pipeline: every stage takes the documents that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact import exact_keep
from tidemark.llm.folds import held_out
from tidemark.llm.language import keep_known, train
from tidemark.llm.mixing import mix_documents
from tidemark.llm.packing import packed_documents
from tidemark.llm.simhash import simhash_keep
from tidemark.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found stay; those without a letter go."""
    model = train(docs.where(~held_out(F.col("doc_id"))), docs_per_language=2000)
    return keep_known(docs, model)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest ``doc_id`` stays."""
    return exact_keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest ``doc_id``."""
    return simhash_keep(docs, shingle=3, max_distance=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in whole copies."""
    return mix_documents(docs, block_words=256, weights=(1, 2, 3), most_copies=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequence of 2048 tokens and the place they are packed at."""
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Hashes, learned models and token ids are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
