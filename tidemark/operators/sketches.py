"""Column profiles that grow load by load: mergeable sums and sketches, stored per load.

A load is read once, when it is added. Distinct counts come from HyperLogLog
sketches, medians from KLL sketches; counts, bounds, means and deviations are
exact. A profile merges the stored rows, one per load and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import TEXTUAL, is_missing, quoted
from ..session import scratch_path

#: Two to this many registers: a relative standard error of 1.6 % at 12.
HLL_BITS = 12
#: Items per level of a quantile sketch: ranks are off by about 1.3 % at 200.
KLL_ITEMS = 200


def _state(name: str, kind: T.DataType) -> Column:
    value = F.col(quoted(name))
    # NaN is missing, and the two zeros are one value
    present = F.when(~is_missing(value, kind), value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        present = F.when(present == 0, F.lit(0.0)).otherwise(present)
    none = F.lit(None)
    number = present.cast("double") if isinstance(kind, T.NumericType) else none.cast("double")
    finite = F.when(F.abs(number) < float("inf"), number)
    length = F.length(present).cast("double") if isinstance(kind, TEXTUAL) else none.cast("double")
    numeric = isinstance(kind, T.NumericType)
    return F.struct(
        F.lit(name).alias("column"),
        F.count(F.lit(1)).alias("rows"),
        F.count(present).alias("present"),
        F.hll_sketch_agg(present.cast("string"), HLL_BITS).alias("distinct"),
        (F.kll_sketch_agg_double(finite, F.lit(KLL_ITEMS)) if numeric else none.cast("binary")).alias("quantiles"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.count(number).alias("numbers"),
        F.avg(number).alias("mean"),
        F.var_pop(number).alias("variance"),
        F.sum(length).alias("length"),
        F.max(length).alias("max_length"),
    )


class ProfileStore:
    """Profiles of the loads of one table, below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "profiles")

    def add(self, load: DataFrame, name: str) -> None:
        """Stores the state of one load, in one pass over it; a load added again under its name replaces itself."""
        states = load.agg(F.array(*[_state(f.name, f.dataType) for f in load.schema]).alias("s"))
        states.select(F.inline("s")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/load={name}")

    def profile(self) -> DataFrame:
        """One row per column over all loads.

        ``unique_count`` and ``median`` are estimates; ``std`` is the sample
        deviation, 0 for one value. A column that a load lacks has no rows in it.
        """
        states = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/load=*")
        weight = F.col("numbers") * F.col("mean")
        first = states.groupBy("column").agg(
            F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.sum("numbers").alias("n"),
            F.sum(weight).alias("total"), F.min("min").alias("min"), F.max("max").alias("max"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
            F.kll_merge_agg_double("quantiles").alias("quantiles"),
            F.sum("length").alias("length"), F.max("max_length").alias("max_length"),
            # each load's square distances from its own mean, and from zero
            F.collect_list(F.struct("numbers", "mean", "variance")).alias("parts"),
        )
        mean = F.try_divide("total", "n")
        squares = F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.when(p["numbers"] > 0, p["numbers"] * (p["variance"] + (p["mean"] - F.col("average")) * (p["mean"] - F.col("average")))).otherwise(0.0))
        merged = first.withColumn("average", mean).withColumn("squares", squares)
        ratio = lambda part: F.coalesce(F.try_divide(part.cast("double"), F.col("rows")), F.lit(0.0))
        missing = F.col("rows") - F.col("present")
        numeric = F.col("n") > 0
        some = F.coalesce(F.call_function("kll_sketch_get_n_double", "quantiles"), F.lit(0)) > 0
        return merged.select(
            "column", "rows", missing.alias("null_count"), ratio(missing).alias("null_ratio"),
            F.when(F.col("present") > 0, F.least("distinct", "present")).otherwise(0).cast("long").alias("unique_count"),
            "min", "max", F.col("average").alias("mean"),
            F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("median"),
            F.when(numeric, F.sqrt(F.coalesce(F.try_divide("squares", F.col("n") - 1), F.lit(0.0)))).alias("std"),
            F.try_divide("length", F.col("present")).alias("avg_length"), F.col("max_length").cast("long").alias("max_length"),
        )
