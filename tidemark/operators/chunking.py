"""Word windows over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_words, split_words

# Sizes in characters; four characters count as a word.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50


def window(chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> tuple[int, int]:
    """Words per chunk and words between two starts."""
    size = chunk_size // 4
    stride = size - overlap // 4
    if stride <= 0:
        raise ValueError("the overlap must be smaller than the chunk")
    return size, stride


def chunk_documents(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """(id, chunk_no, start_idx, end_idx, text), windows in words.

    Windows start every size - overlap words, so the last one may lie wholly
    inside the one before. A text without words has no chunks.
    """
    size, stride = window(chunk_size, overlap)
    # filtered by the text, not by its words: Spark moves the filter to the scan
    present = documents.filter(has_words(F.col(text_column)))
    split = present.select(F.col(id_column), split_words(F.col(text_column)).alias("__words"))
    sized = split.withColumn("__n", F.size("__words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("__n") - 1), F.lit(stride))
    placed = sized.select(id_column, "__words", "__n", F.posexplode(starts).alias("chunk_no", "start_idx"))
    return placed.select(
        id_column,
        "chunk_no",
        "start_idx",
        F.least(F.col("start_idx") + size, F.col("__n")).alias("end_idx"),
        F.array_join(F.slice("__words", F.col("start_idx") + 1, size), " ").alias("text"),
    )
