"""Exact medians of many columns without one task or one buffer holding a whole column.

All columns are one table of (column, value, number of rows), ordered by range
partitions. The sums of the partitions tell in which of them the middle of
each column lies, so only those two at most are read row by row, each on its
own. The same path serves every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import null_if_missing, quoted
from ..session import cut_lineage


def _value(df: DataFrame, name: str) -> Column:
    column = F.col(quoted(name))
    # the two zeros are one value
    return null_if_missing(column, df.schema[name].dataType).cast("double") + F.lit(0.0)


def exact_medians(df: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """Rows (column, median); NULL and NaN are ignored, infinities count.

    ``partitions`` is the number of range partitions, by default that of any shuffle.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, median double")
    cells = F.array_compact(F.array(*[
        F.when(_value(df, c).isNotNull(), F.struct(F.lit(i).alias("i"), _value(df, c).alias("value"))) for i, c in enumerate(columns)
    ]))
    per_value = df.select(F.inline(cells)).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    keys = ["i", "value"]
    ranged = per_value.repartitionByRange(partitions, *keys) if partitions else per_value.repartitionByRange(*keys)
    held = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    # a row per column and partition
    order = Window.partitionBy("i").orderBy("part")
    parts = held.groupBy("i", "part").agg(F.sum("n").alias("rows"))
    parts = parts.withColumn("before", F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("before", F.coalesce("before", F.lit(0))).withColumn("total", F.sum("rows").over(Window.partitionBy("i")))
    first, last = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = parts.withColumn("first", first).withColumn("last", last)
    middle = middle.where("before <= last and first < before + rows").drop("rows")
    # two partitions of each column at most
    near = held.join(F.broadcast(middle), ["i", "part"])
    running = Window.partitionBy("i", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("before") + F.sum("n").over(running))
    picked = near.where("upto > first and upto - n <= last").groupBy("i").agg(((F.min("value") + F.max("value")) / 2).alias("median"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "i int, column string")
    return names.join(F.broadcast(picked), "i", "left").select("column", "median")
