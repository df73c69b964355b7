"""Writers. JSON is always written as JSON Lines, one object per line."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_root, spread

# tasks get these functions by value, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Files in one folder, about.
FOLDER_FILES = 1000


def write(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists",
          partition_by: list[str] | None = None, **options) -> str:
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if file_format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif file_format in ("json", "jsonl"):
        writer.option("ignoreNullFields", False).json(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {file_format!r}: use csv, json, jsonl or parquet")
    return path


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """A text file per value of ``name``, below a fresh ``path`` in the shared folder; the value stands as ``name=value`` in its path.

    Texts of equal names are lines of one file. Where the shared folder is a
    mounted one, tasks write the files side by side in folders of about
    ``FOLDER_FILES``; elsewhere Spark writes a folder for each of them, which
    the tasks, not the driver, move into place.
    """
    spark = df.sparkSession
    rows = spread(df.select(F.col(text).alias("text"), F.col(name).alias(name)), name)
    shared_root(spark)
    # the folder's full name tells its file system
    if not spark.sparkContext.getCheckpointDir().startswith("file:"):
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(name).text(path)
        return
    folders = max(1, -(-df.count() // FOLDER_FILES))
    root = path.removeprefix("file:")
    dealt = rows.select(F.pmod(F.xxhash64(name), F.lit(folders)).alias("folder"), F.col(name).cast("string").alias("name"), "text")
    dealt = dealt.repartition(folders, "folder").sortWithinPartitions("folder", "name")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((r["folder"], r["name"], r["text"]) for batch in batches for r in batch.to_pylist())
        written = 0
        for (folder, value), group in groupby(found, lambda r: r[:2]):
            where = f"{root}/folder={folder}"
            os.makedirs(where, exist_ok=True)
            # a task that is repeated writes the same files
            with open(f"{where}/{name}={'null' if value is None else value}.txt", "wb") as file:
                file.writelines((t or "").encode() + b"\n" for _, _, t in group)
            written += 1
        yield pa.RecordBatch.from_pydict({"written": pa.array([written], pa.int64())})

    os.makedirs(root, exist_ok=True)
    dealt.mapInArrow(task, "written long").agg(F.sum("written")).collect()
