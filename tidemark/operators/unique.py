"""Uniqueness enforced in row order.

Whether a row is kept hangs on earlier rows that share a value with it, so
rows in different components of rows that share values decide nothing for each
other. A few rounds over all rows settle most of them; what is left is cut into
components, and tasks go through whole components row by row. Of a component
too large for a task the first rows are settled that way, which settle others.
"""

from __future__ import annotations

import sys
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import quoted
from ..session import cut_lineage, settled

# A value held by more than 1/HOT_SHARE of the open rows is hot, so there are
# at most HOT_SHARE hot values per column.
HOT_SHARE = 1000
#: Rows that one task goes through one by one.
TASK_ROWS = 200_000
#: Rounds over all open rows before components are looked for.
ROUNDS = 2

# tasks get these functions by value, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def enforce_unique(df: DataFrame, columns: list[str], order_by: str) -> DataFrame:
    """Keeps a row unless a kept earlier row has the same value in a unique column.

    NULL never clashes. ``order_by`` must be unique; it stands for row order.
    """
    if len(columns) == 1:
        return _first_of_value(df, columns[0], order_by)
    return df.join(_kept_rows(df, columns, order_by), order_by, "left_semi")


def _first_of_value(df: DataFrame, column: str, order_by: str) -> DataFrame:
    value, seq = F.col(quoted(column)), F.col(quoted(order_by))
    # every NULL is a group of its own
    row = F.struct(*[F.col(quoted(c)) for c in df.columns])
    groups = df.groupBy(value.alias("__v"), F.when(value.isNull(), seq).alias("__n"))
    return groups.agg(F.min_by(row, seq).alias("__row")).select("__row.*")


def _kept_rows(df: DataFrame, columns: list[str], order_by: str) -> DataFrame:
    """Order keys of the kept rows."""
    names = [f"v{i}" for i in range(len(columns))]
    seq = F.col(quoted(order_by))
    open_rows = cut_lineage(df.select(seq.alias("seq"), *[F.col(quoted(c)).alias(n) for c, n in zip(columns, names)]))
    total = open_rows.count()
    # values only lose holders, so what is not hot now never will be
    hot = {n: _hot_values(open_rows, n, total) for n in names}
    kept_parts = []
    while total:
        for _ in range(ROUNDS):
            kept = _first_of_all(open_rows, names)
            kept_parts.append(kept.select("seq"))
            open_rows = _without_kept(open_rows, kept, names, hot)
        total = open_rows.count()
        if not total:
            break
        if total <= TASK_ROWS:
            kept_parts.append(_settled(open_rows, names, F.lit(0)))
            break
        labels = _components(open_rows, names)
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        small = cut_lineage(open_rows.join(labels.join(sizes.where(F.col("size") <= TASK_ROWS).select("label"), "label", "left_semi"), "seq"))
        tasks = -(-total // TASK_ROWS)
        kept_parts.append(_settled(small, names, F.pmod(F.xxhash64("label"), F.lit(tasks))))
        open_rows = cut_lineage(open_rows.join(small.select("seq"), "seq", "left_anti"))
        # all rows before one of these are among them
        first = open_rows.orderBy("seq").limit(TASK_ROWS)
        kept = cut_lineage(first.join(_settled(first, names, F.lit(0)), "seq", "left_semi"))
        kept_parts.append(kept.select("seq"))
        open_rows = _without_kept(open_rows.join(first.select("seq"), "seq", "left_anti"), kept, names, hot)
        total = open_rows.count()
    if not kept_parts:
        return df.select(F.col(quoted(order_by))).limit(0)
    every = reduce(lambda a, b: a.unionByName(b), kept_parts)
    return every.select(F.col("seq").alias(order_by))


def _first_of_all(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows that come first for all of their values; at least the first row is one."""
    needed = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names])
    firsts = [rows.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("seq").alias("seq")).select("seq") for n in names]
    # joined on seq, which no two rows share
    won = reduce(lambda a, b: a.unionByName(b), firsts).groupBy("seq").agg(F.count(F.lit(1)).alias("wins"))
    return cut_lineage(rows.join(won, "seq", "left").where(F.coalesce("wins", F.lit(0)) == needed).select("seq", *names))


def _without_kept(rows: DataFrame, kept: DataFrame, names: list[str], hot: dict[str, DataFrame | None]) -> DataFrame:
    """The rows that are neither kept nor share a value with a kept one."""
    left = rows.join(kept.select("seq"), "seq", "left_anti")
    for name in names:
        left = _without_values(left, name, kept.where(F.col(name).isNotNull()).select(name), hot[name])
    return cut_lineage(left)


def _components(rows: DataFrame, names: list[str]) -> DataFrame:
    """(seq, label): rows linked by shared values have one label, the smallest ``seq`` among them.

    Every row is linked to the first row of each of its values. Stars around
    the smallest neighbour replace the links until nothing changes: the number
    of rounds grows with the logarithm of the longest chain.
    """
    links = []
    for name in names:
        held = rows.where(F.col(name).isNotNull()).select("seq", name)
        links.append(held.join(held.groupBy(name).agg(F.min("seq").alias("low")), name).select(F.col("seq").alias("high"), "low"))
    edges = cut_lineage(reduce(lambda a, b: a.unionByName(b), links).where("high > low").distinct())
    seen = None
    while True:
        # larger neighbours go to the smallest neighbour, or the row itself
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.min("low").alias("least")).withColumn("least", F.least("least", "high"))
        spread_out = both.join(least, "high").where("low > high").select(F.col("low").alias("high"), F.col("least").alias("low")).where("high > low").distinct()
        # smaller neighbours, and the row, go to the smallest of them
        least = spread_out.groupBy("high").agg(F.min("low").alias("least"))
        joined = spread_out.join(least, "high")
        inner = joined.where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        edges = cut_lineage(inner.unionByName(least.withColumnRenamed("least", "low")).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return rows.select("seq").join(edges.withColumnRenamed("high", "seq"), "seq", "left").select("seq", F.coalesce("low", "seq").alias("label"))


def _comparable(name: str, kind: T.DataType) -> Column:
    """A value as text that equals another's where Spark groups the two."""
    value = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.when(value == 0, F.lit(0.0).cast(kind)).otherwise(value)
    return value.cast("string").alias(name)


def _settled(rows: DataFrame, names: list[str], group: Column) -> DataFrame:
    """The kept ones among rows whose earlier neighbours are in the same group, found row by row in a task per group."""
    schema = rows.select("seq").schema
    plain = rows.select("seq", *[_comparable(n, rows.schema[n].dataType) for n in names], group.alias("group"))

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        taken: list[set] = [set() for _ in names]
        kept = []
        for values in zip(*(table.column(n).to_pylist() for n in names)):
            free = all(v is None or v not in held for v, held in zip(values, taken))
            kept.append(free)
            if free:
                for v, held in zip(values, taken):
                    held.add(v)
        return table.select(["seq"]).filter(pa.array(kept, pa.bool_()))

    return cut_lineage(plain.groupBy("group").applyInArrow(settle, schema))


def _hot_values(rows: DataFrame, name: str, total: int) -> DataFrame | None:
    """At most HOT_SHARE values, as a local frame."""
    counts = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("holders"))
    hot = settled(counts.filter(F.col("holders") > max(1, total // HOT_SHARE)).select(name))
    return None if hot.isEmpty() else hot


def _without_values(rows: DataFrame, name: str, taken: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows whose value is not taken.

    Rows of the few hot values meet a broadcast list; only the others shuffle.
    """
    if hot is None:
        return rows.join(taken, name, "left_anti")
    hot_taken = F.broadcast(taken.join(F.broadcast(hot), name, "left_semi"))
    cold_taken = taken.join(F.broadcast(hot), name, "left_anti")
    # hot rows that are not taken still reach the second join; told apart, they skip it
    marked = rows.join(hot_taken, name, "left_anti").join(
        F.broadcast(hot.withColumn("hot", F.lit(True))), name, "left"
    )
    cold = marked.filter("hot IS NULL").drop("hot").join(cold_taken, name, "left_anti")
    return marked.filter("hot").drop("hot").select(*rows.columns).unionByName(cold.select(*rows.columns))
