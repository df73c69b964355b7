"""Text documents from files and tables."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import quoted
from ..functions.text import strip_spaces
from ..session import cut_lineage

# tasks get these functions by value, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Names of files that a task hands on together.
LISTED_ROWS = 10_000
#: Files that a task reads before it hands them on: bytes, and how many at most.
READ_BYTES, READ_ROWS = 4 << 20, 1000
#: Bytes of files for a task.
TASK_BYTES = 64 << 20


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder, if the path names one that the machines have mounted."""
    if any(c in "{}[]*?\\" for c in path):
        return None
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" and os.path.isdir(uri.getPath()) else None


def _hidden(name: str) -> bool:
    """Whether Spark's own readers pass over a file or folder of this name."""
    left_out = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
    return left_out and not name.startswith(("_metadata", "_common_metadata"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: what lies in each folder: a path with the length of a file, or without one if it is a folder."""
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            paths, lengths = [], []
            with os.scandir(folder) as entries:
                for entry in entries:
                    if _hidden(entry.name):
                        continue
                    try:
                        entry.name.encode()
                        length = None if entry.is_dir() else entry.stat().st_size
                    except (UnicodeEncodeError, FileNotFoundError):
                        continue  # no name that Spark could ask for, or a link to nothing
                    paths.append(entry.path)
                    lengths.append(length)
                    if len(paths) == LISTED_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["path", "length"])
                        paths, lengths = [], []
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["path", "length"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the bytes of the files, a few megabytes at a time."""
    for batch in batches:
        paths, lengths = batch.column("path").to_pylist(), batch.column("length").to_pylist()
        first, held = 0, []
        for k, path in enumerate(paths):
            with open(path, "rb") as file:
                held.append(file.read())
            if sum(lengths[first : k + 1]) >= READ_BYTES or len(held) == READ_ROWS or k + 1 == len(paths):
                columns = [pa.array(["file:" + p for p in paths[first : k + 1]], pa.string()), pa.array(lengths[first : k + 1], pa.int64()), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "length", "content"])
                first, held = k + 1, []


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length, content) of the files below a mounted folder, listed and read by tasks, level by level of the folders."""
    cores = spark.sparkContext.defaultParallelism
    # Hadoop's pattern for names, as its listing applies it
    names = f"(?s)^(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(pattern).pattern()})\\z"
    folders, levels = spark.createDataFrame([(root,)], "path string"), []
    while not folders.isEmpty():
        found = cut_lineage(folders.repartition(cores, "path").mapInArrow(_listed, "path string, length long"))
        folders = found.where("length IS NULL").select("path")
        levels.append(found.where(F.col("length").isNotNull() & F.element_at(F.split("path", "/"), -1).rlike(names)))
    files = reduce(DataFrame.unionByName, levels)
    size = files.agg(F.sum("length")).first()[0] or 0
    return files.repartition(max(cores, -(-size // TASK_BYTES)), "path").mapInArrow(_contents, "path string, length long, content binary")


def scan_text_documents(spark: SparkSession, path: str, pattern: str = "*.{[tT][xX][tT],[mM][dD]}") -> DataFrame:
    """(filename, path, size, text) of every text file below a path.

    Bytes that are not UTF-8 are read as Latin-1, which accepts any byte; the
    encoding tried after that could never be reached. Blank files are left out.
    A mounted folder is listed by the tasks, so the driver holds nothing for a
    file; elsewhere Spark's reader lists the files on the driver.
    """
    root = _mounted(spark, path)
    if root:
        files = _files(spark, root, pattern)
    else:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true")
            .load(path)
        )
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode("content", "ISO-8859-1"))
    named = files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.col("length").alias("size"), text.alias("text")
    )
    return named.filter(strip_spaces(F.col("text")) != "")


def table_to_lines(df: DataFrame, order_by: list[str], separator: str = " | ", null_text: str = "nan") -> DataFrame:
    """The text form of a table: (position, line), the header at position NULL first.

    A document of a whole table would have to pass through one task, so the
    lines stay rows; ``position`` is the ordering key of the row.
    """
    cells = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit(null_text)) for c in df.columns]
    position = F.struct(*[F.col(quoted(c)) for c in order_by])
    body = df.select(F.to_json(position).alias("position"), F.concat_ws(separator, *cells).alias("line"))
    header = df.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("position"), F.lit(separator.join(df.columns)).alias("line")
    )
    return header.unionByName(body)
