"""Readers of tabular files."""

from __future__ import annotations

import csv
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import TEXTUAL, quoted, sanitize_frame
from .detect import DELIMITERS, detect_dialect, lines_of


class CsvSplit(NamedTuple):
    good: DataFrame
    rejected: DataFrame


def _struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _csv_reader(spark, sep, encoding, header, multi_line):
    return (
        spark.read.option("sep", sep)
        .option("encoding", encoding)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    sep: str = ",",
    encoding: str = "utf-8",
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a dialect. Without a schema Spark reads the data once more to infer it.

    ``multi_line`` allows line breaks inside quotes but keeps each file in one task.
    """
    windows = encoding.lower() in ("windows-1252", "cp1252")
    reader = _csv_reader(spark, sep, "iso-8859-1" if windows else encoding, header, multi_line)
    # such lines end in two bytes
    reader = reader.option("lineSep", "\n") if encoding.lower().startswith("utf-16") and not multi_line else reader
    rows = reader.option("inferSchema", True).csv(path) if schema is None else reader.schema(schema).csv(path)
    return _windows_text(rows) if windows else rows


# What windows-1252 prints where ISO-8859-1 has control characters (five bytes are unused).
WINDOWS_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
WINDOWS_SIGNS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def _windows_text(rows: DataFrame) -> DataFrame:
    """Text read as ISO-8859-1 with the signs of windows-1252, which Spark's reader does not know."""
    return rows.select(*[
        F.translate(F.col(quoted(f.name)), WINDOWS_BYTES, WINDOWS_SIGNS).alias(f.name) if isinstance(f.dataType, TEXTUAL) else F.col(quoted(f.name))
        for f in rows.schema
    ])


def scan_csv_tolerant(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ",",
    encoding: str = "utf-8",
    header: bool = True,
    multi_line: bool = False,
) -> CsvSplit:
    """Lines with too many fields are rejected, short lines are padded with NULL.

    The reader keeps the text of every line whose field count is off; its marks
    outside quotes tell the long lines from the short ones. Values that do not
    convert to their type become NULL.
    """
    fields = _struct(schema).fields
    names = [f"f{i}" for i in range(len(fields))]
    raw_schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "raw"]])
    lines = (
        _csv_reader(spark, sep, encoding, header, multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "raw")
        # the field count must not depend on the columns a query selects
        .option("columnPruning", False)
        .schema(raw_schema)
        .csv(path)
    )
    unquoted = F.regexp_replace("raw", '"[^"]*"', "")
    marks = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep)))
    too_long = F.coalesce(marks >= len(fields), F.lit(False))

    def value(i: int, field: T.StructField) -> Column:
        text = F.col(f"f{i}")
        typed = text if isinstance(field.dataType, TEXTUAL) else text.try_cast(field.dataType)
        return typed.alias(field.name)

    good = lines.filter(~too_long).select(*[value(i, f) for i, f in enumerate(fields)])
    # naming a field as well: Spark refuses plans that read the raw text alone
    rejected = lines.filter(too_long).select(F.coalesce("raw", "f0").alias("line"))
    return CsvSplit(good, rejected)


def scan_csv_detected(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
    suffix: str | None = ".csv",
) -> DataFrame:
    """All CSV files below a path, each read with the dialect found for it.

    The lines are read once, as bytes, and joined with the dialect of their
    file, so no list of files is held anywhere. The files share their columns,
    by position; a line break inside quotes ends the line. Without a schema
    the names are those of the first file, and the types are found in a pass
    over all values. A UTF-16 file fails the job: its lines cannot be told from
    its bytes; ``scan_csv`` reads it by its encoding.
    """
    lines = lines_of(spark, path, suffix).withColumn("at", F.monotonically_increasing_id()).where(F.trim("value") != "")
    dialects = detect_dialect(spark, path, suffix).select("file", "encoding", "delimiter")
    if dialects.isEmpty():
        raise ValueError(f"no files to read below {path}")
    placed = lines.join(dialects, "file")
    if header:
        first = lines.where(F.col("block_start") == 0).groupBy("file").agg(F.min("at").alias("first"))
        placed = placed.join(first, "file", "left").where(~F.col("at").eqNullSafe(F.col("first")))
    fields = _struct(schema).fields if schema is not None else None
    if fields is None:
        names = _header_names(lines.join(dialects, "file"), header)
        texts = _parsed(placed, [T.StructField(n, T.StringType()) for n in names])
        fields = _found_types(texts)
    return _parsed(placed, fields)


def _decoded() -> Column:
    """The text of a line by its file's ``encoding``."""
    value, encoding = F.col("value"), F.col("encoding")
    plain = F.decode(value.cast("binary"), "ISO-8859-1")
    refused = F.raise_error(F.concat(F.col("file"), F.lit(" is written in "), encoding, F.lit(": read it with scan_csv"))).cast("string")
    return (
        F.when(encoding == "utf-8", value)
        .when(encoding == "windows-1252", F.translate(plain, WINDOWS_BYTES, WINDOWS_SIGNS))
        .when(encoding == "iso-8859-1", plain)
        .otherwise(refused)
    )


def _parsed(lines: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Lines with their ``encoding`` and ``delimiter`` as rows: a parser for each delimiter."""
    row = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
    cells = F.lit(None).cast(f"struct<{', '.join(f'{quoted(f.name)}: {f.dataType.simpleString()}' for f in fields)}>")
    for mark in DELIMITERS:
        parsed = F.from_csv("line", row, {"sep": mark, "quote": '"', "escape": '"'})
        cells = F.when(F.col("delimiter") == mark, parsed).otherwise(cells)
    return lines.withColumn("line", _decoded()).select(cells.alias("cells")).select("cells.*")


def _header_names(lines: DataFrame, header: bool) -> list[str]:
    """Column names from the first line of the first file."""
    first = lines.where(F.col("block_start") == 0).withColumn("line", _decoded()).orderBy("file", "at").select("line", "delimiter").first()
    cells = next(csv.reader([first["line"]], delimiter=first["delimiter"]))
    return cells if header else [f"_c{i}" for i in range(len(cells))]


def _found_types(texts: DataFrame) -> list[T.StructField]:
    """The first type that all values of a column have; one pass for all columns."""
    kinds = [T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType()]
    fits = [
        F.bool_and(F.col(quoted(n)).isNull() | F.col(quoted(n)).try_cast(k).isNotNull()).alias(f"{i}_{j}")
        for i, n in enumerate(texts.columns) for j, k in enumerate(kinds)
    ]
    counts = [F.count(F.col(quoted(n))).alias(f"n_{i}") for i, n in enumerate(texts.columns)]
    found = texts.agg(*fits, *counts).first()
    return [
        T.StructField(n, next((k for j, k in enumerate(kinds) if found[f"n_{i}"] and found[f"{i}_{j}"]), T.StringType()))
        for i, n in enumerate(texts.columns)
    ]


def with_file_order(scanned: DataFrame, name: str = "file_order") -> DataFrame:
    """Adds the place of each row in its files, for operators that take an order.

    Only for a frame that comes straight from a file scan: a task reads a
    split from front to back, so its row ids grow along the file.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return scanned.withColumn(name, place)


def scan_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> tuple[DataFrame, str]:
    """JSON array or JSON Lines, and which of the two it is (``json``, ``jsonl``)."""
    head = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1)).first()
    kind = "json" if head is not None and head[0] == "[" else "jsonl"
    reader = spark.read.option("multiLine", kind == "json")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path), kind


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_delta(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.format("delta").load(path)
    except (PySparkException, Py4JJavaError) as error:
        if "ClassNotFound" in str(error) or "DATA_SOURCE_NOT_FOUND" in str(error):
            raise RuntimeError("reading Delta tables needs the Delta connector on the classpath") from error
        raise


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by file extension: csv, json, jsonl, parquet or delta."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension == "csv":
        return scan_csv(spark, path, **options)
    if extension in ("json", "jsonl"):
        return scan_json(spark, path, **options)[0]
    if extension == "parquet":
        return scan_parquet(spark, path)
    if extension == "delta":
        return scan_delta(spark, path)
    raise ValueError(f"unsupported file extension {extension!r}: use .csv, .json, .jsonl, .parquet or .delta")


def row_cap_guard(df: DataFrame, max_rows: int) -> DataFrame:
    """The frame itself, or an error if it has more than ``max_rows`` rows.

    At most ``max_rows + 1`` rows are read to find out.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"the dataset has more than {max_rows:,} rows")
    return df


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """The first rows, with NaN and infinities as NULL."""
    return sanitize_frame(df.orderBy(*[F.col(quoted(c)) for c in order_by]).limit(n))


def parse_delimited_lines(lines: DataFrame, names: list[str], sep: str = ",") -> DataFrame:
    """Raw delimited lines (``file``, ``at``, ``line``) to text columns.

    Blank lines and lines of another arity go, and so do the lines at the
    beginning of a file that look like headers (a first cell with a letter and
    ``_``), up to the first line that is kept.
    """
    present = lines.filter(F.regexp_replace("line", rf"(?U)[\s\Q{sep}\E]", "") != "")
    # "raw" stays empty exactly where the line has the expected arity
    schema = ", ".join([*(f"c{i} STRING" for i in range(len(names))), "raw STRING"])
    options = {"sep": sep, "columnNameOfCorruptRecord": "raw"}
    cells = present.withColumn("c", F.from_csv("line", schema, options))
    first_cell = F.get(F.split(F.col("line"), rf"\Q{sep}\E"), F.lit(0))
    fitting = cells.filter(F.col("c.raw").isNull()).select(
        "file", "at", *[F.col(f"c.c{i}").alias(n) for i, n in enumerate(names)],
        (first_cell.rlike(r"\p{L}") & first_cell.contains("_")).alias("__header"),
    )
    # the place of the first line that is data, per file; combined where the lines lie
    begins = fitting.groupBy("file").agg(F.min(F.when(~F.col("__header"), F.col("at"))).alias("__begin"))
    # files are the key of the join: a very long one is split by adaptive execution
    placed = fitting.join(begins, "file")
    return placed.filter(F.col("at") >= F.col("__begin")).drop("__header", "__begin")
