"""Encoding and delimiter of every file below a path, found by Spark tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = [",", ";", "\t", "|"]


def lines_of(spark: SparkSession, path: str, suffix: str | None) -> DataFrame:
    """(value, file, block_start): every line below a path, its bytes unchanged."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def detect_encoding(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """(file, encoding): by the byte-order mark, else UTF-8 if every line of the file is valid, else one of two single-byte encodings.

    A mark tells ``utf-16le`` and ``utf-16be``; without one, a zero among the
    first two bytes is half of a UTF-16 character. Spark's readers take the mark
    off UTF-8 files. Bytes 0x80 to
    0x9f are control characters in ISO-8859-1 and printed ones in
    windows-1252, so a file that has some is the latter.

    The text source hands bytes over unchanged, so validity is tested on the
    whole file, split by split, rather than on its first bytes.
    """
    lines = lines_of(spark, path, suffix).withColumn("at", F.monotonically_increasing_id())
    plain = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    # numbers and truth values only: grouping them is hashed, strings would have the lines sorted by file
    start = F.hex(F.substring(F.col("value").cast("binary"), 1, 2))
    facts = lines.select(
        "file",
        F.when(F.col("block_start") == 0, F.col("at")).alias("at"),
        # a leading digit keeps zeros and the length
        F.conv(F.concat(F.lit("1"), start), 16, 10).cast("int").alias("start"),
        F.is_valid_utf8("value").alias("valid"),
        (~F.is_valid_utf8("value") & plain.rlike(r"[\x80-\x9f]")).alias("printed"),
    )
    # of the file's first split, whose smallest id is line one
    found = facts.groupBy("file").agg(
        F.min_by("start", "at").alias("start"), F.bool_and("valid").alias("valid"), F.bool_or("printed").alias("printed")
    )
    found = found.withColumn("mark", F.substring(F.hex("start"), 2, 4))
    encoding = (
        F.when(F.col("mark").startswith("FFFE") | (F.substring("mark", 3, 2) == "00"), "utf-16le")
        .when(F.col("mark").startswith("FEFF") | (F.substring("mark", 1, 2) == "00"), "utf-16be")
        .when(F.col("valid"), "utf-8")
        .when(F.col("printed"), "windows-1252")
        .otherwise("iso-8859-1")
    )
    return found.select("file", encoding.alias("encoding"))


def _occurrences(text, mark: str):
    return F.length(text) - F.length(F.replace(text, F.lit(mark)))


def detect_delimiter(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """(file, delimiter, columns): the mark that cuts the first line into most columns.

    Marks inside quotes do not count; on a tie the order ``, ; tab |`` decides.
    """
    numbered = lines_of(spark, path, suffix).withColumn("at", F.monotonically_increasing_id())
    # A file's first split is read by one task in order, so its smallest id is line one.
    first = (
        numbered.filter((F.col("block_start") == 0) & (F.trim("value") != ""))
        .groupBy("file")
        .agg(F.min_by("value", "at").alias("line"))
        .withColumn("line", F.regexp_replace("line", '"[^"]*"', ""))
    )
    counts = [_occurrences(F.col("line"), d).alias(f"c{i}") for i, d in enumerate(DELIMITERS)]
    counted = first.select("file", *counts)
    best = F.greatest(*[F.col(f"c{i}") for i in range(len(DELIMITERS))])
    choice = F.lit(DELIMITERS[0])
    for i in reversed(range(len(DELIMITERS))):
        choice = F.when(F.col(f"c{i}") == best, F.lit(DELIMITERS[i])).otherwise(choice)
    return counted.select("file", choice.alias("delimiter"), (best + 1).cast("long").alias("columns"))


def detect_dialect(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    return detect_encoding(spark, path, suffix).join(detect_delimiter(spark, path, suffix), "file", "left")
