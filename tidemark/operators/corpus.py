"""Upkeep of a document collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_spaces


def import_new(indexed: DataFrame, incoming: DataFrame, name: str = "filename", text: str = "text") -> DataFrame:
    """The collection with the incoming files added whose name is new and text not blank."""
    fresh = incoming.filter(strip_spaces(F.col(text)) != "").join(
        indexed.select(name).distinct(), name, "left_anti"
    )
    return indexed.unionByName(fresh.select(*indexed.columns))


def delete_documents(documents: DataFrame, ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return documents.join(ids.select(id_column).distinct(), id_column, "left_anti")


def list_sources(documents: DataFrame, id_column: str = "doc_id", size: str = "n_chars") -> DataFrame:
    """(id, filename, size) by file name."""
    return documents.select(
        F.col(id_column).alias("id"),
        F.coalesce("filename", F.lit("unknown")).alias("filename"),
        F.coalesce(size, F.lit(0)).alias("size"),
    ).orderBy("filename", "id")


# Limits and texts that mark a document as shallow.
SHALLOW_CHARS = 100
GENERIC_TEXT = "Test document about data quality"


def shallow_reason(text: Column, filename: Column) -> Column:
    """Why a document should go, or NULL to keep it."""
    short = F.length(text) < SHALLOW_CHARS
    return (
        F.when(short & F.lower(filename).contains("test"), "small_test_document")
        .when(short, "small_content")
        .when(strip_spaces(text) == GENERIC_TEXT, "generic_test_document")
    )


def shallow_documents(documents: DataFrame) -> DataFrame:
    """Documents with their reason to be removed; NULL means keep."""
    return documents.withColumn("reason", shallow_reason(F.col("text"), F.col("filename")))


def corpus_stats(documents: DataFrame, chunks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    texts = documents.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"),
        F.lit(1).alias("__one"),
    )
    parts = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.lit(1).alias("__one"))
    return texts.join(F.broadcast(parts), "__one").select("documents", "chunks", "characters")


def markdown_title(text: Column, filename: Column) -> Column:
    """First line of a .md file if it is a heading."""
    line = strip_spaces(F.substring_index(text, "\n", 1))
    title = strip_spaces(F.regexp_replace(line, "^#+", ""))
    return F.when(F.lower(filename).endswith(".md") & line.startswith("#"), title)
