"""Column profiles, frequent values and the rules they suggest."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import is_missing, quoted, text_columns
from ..session import cut_lineage
from . import metrics


def spark_type_name(dtype: T.DataType) -> str:
    """Type name as rule sets and schemas spell it."""
    known = {
        T.LongType: "long",
        T.IntegerType: "integer",
        T.ShortType: "integer",
        T.ByteType: "integer",
        T.DoubleType: "double",
        T.FloatType: "float",
        T.StringType: "string",
        T.BooleanType: "boolean",
        T.TimestampType: "timestamp",
        T.TimestampNTZType: "timestamp",
    }
    return known.get(type(dtype), "string")


def null_counts(df: DataFrame) -> DataFrame:
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.count_if(is_missing(F.col(quoted(f.name)), f.dataType)).alias("null_count"),
        )
        for f in df.schema
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows chosen by md5 of seed and key: the same on any layout. They are drawn once and kept."""
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in key]))
    return cut_lineage(df.orderBy(rank, *[F.col(quoted(c)) for c in key]).limit(n))


def profile_columns(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per column; ratios are over all rows, missing ones included.

    ``counts`` is a ``value_counts`` of the table, if it is at hand.
    """
    unique = metrics.column_uniqueness(df, counts=counts)
    stats = metrics.column_statistics(df, unique).drop("unique_values", "min_length")
    unique = unique.select("column", "unique_count")
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, spark_type_name(f.dataType))])
    rows = F.col("non_null_count") + F.col("null_count")
    ratio = lambda part: F.coalesce(F.try_divide(F.col(part).cast("double"), rows), F.lit(0.0))
    return stats.join(F.broadcast(unique), "column").select(
        "column",
        F.element_at(types, F.col("column")).alias("type"),
        "null_count",
        ratio("null_count").alias("null_ratio"),
        "unique_count",
        ratio("unique_count").alias("unique_ratio"),
        "min",
        "max",
        "mean",
        "median",
        "std",
        "avg_length",
        "max_length",
    )


def top_values(
    df: DataFrame, k: int = 5, columns: list[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """The ``k`` most frequent values of each text column, ties by value.

    ``counts`` is a ``value_counts`` of the table, if it is at hand.
    """
    columns = columns or text_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint, rank int")
    if counts is None:
        names = columns
        counts = metrics.value_counts(df.select(*[F.col(quoted(c)) for c in columns]))
    else:
        names = df.columns
        counts = counts.filter(F.col("i").isin([names.index(c) for c in columns]))
    names = F.array(*[F.lit(c) for c in names])
    order = Window.partitionBy("i").orderBy(F.desc("n"), "value")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.get(names, F.col("i")).alias("column"), "value", F.col("n").alias("count"), "rank")
    )


def suggest_rules(profile: DataFrame, edits: Mapping[str, Any] | None = None) -> DataFrame:
    """Rules a profile suggests, with user edits per column applied.

    ``edits`` is ``{"columns": {name: {required, unique, range, skip_range,
    format, allowed_values, regex_pattern}}, "cross_validations": [...]}``.
    """
    edits = edits or {}
    per_column = edits.get("columns", {})
    column = F.col("column")
    none = F.lit(None)

    def marked(option):
        names = [c for c, e in per_column.items() if e.get(option)]
        return column.isin(names) if names else F.lit(False)

    def rule(kind, low=none, high=none, argument=none, other=none, key=F.lit(False)):
        return F.struct(
            F.lit(kind).alias("type"),
            column.alias("column"),
            low.cast("double").alias("min"),
            high.cast("double").alias("max"),
            argument.cast("string").alias("argument"),
            other.cast("string").alias("other_column"),
            key.alias("primary_key"),
        )

    def bound(side):
        value = F.col(side)
        for name, edit in per_column.items():
            if side in (edit.get("range") or {}):
                value = F.when(column == name, F.lit(float(edit["range"][side]))).otherwise(value)
        return value

    in_range = F.col("min").isNotNull() & (marked("range") | ~marked("skip_range"))
    rules = [
        F.when((F.col("null_ratio") < 0.05) | marked("required"), rule("not_null")),
        F.when((F.col("unique_ratio") > 0.95) | marked("unique"), rule("uniqueness", key=F.lit(True))),
        F.when(in_range, rule("range", bound("min"), bound("max"))),
    ]
    for name, edit in per_column.items():
        here = column == name
        if edit.get("format"):
            rules.append(F.when(here, rule("format", argument=F.lit(edit["format"]))))
        if edit.get("allowed_values"):
            values = F.to_json(F.array(*[F.lit(str(v)) for v in edit["allowed_values"]]))
            rules.append(F.when(here, rule("in_set", argument=values)))
        if edit.get("regex_pattern"):
            rules.append(F.when(here, rule("regex", argument=F.lit(edit["regex_pattern"]))))
    suggested = profile.select(F.inline(F.array_compact(F.array(*rules))))
    crossed = edits.get("cross_validations", [])
    if crossed:
        extra = [
            ("cross_column_comparison", c["column1"], None, None, c["operator"], c["column2"], False)
            for c in crossed
        ]
        suggested = suggested.unionByName(profile.sparkSession.createDataFrame(extra, suggested.schema))
    return suggested


def suggest_schema(profile: DataFrame, edits: Mapping[str, Any] | None = None) -> DataFrame:
    """(name, type, nullable) a profile suggests, with user edits per column applied."""
    per_column = (edits or {}).get("columns", {})
    kind, nullable = F.col("type"), F.col("null_ratio") > 0
    for name, edit in per_column.items():
        here = F.col("column") == name
        if "type" in edit:
            kind = F.when(here, F.lit(edit["type"])).otherwise(kind)
        if "nullable" in edit:
            nullable = F.when(here, F.lit(bool(edit["nullable"]))).otherwise(nullable)
    return profile.select(
        F.col("column").alias("name"), kind.alias("type"), nullable.alias("nullable"), "null_ratio", "unique_ratio", "min", "max"
    )


def as_rule_dicts(suggested: DataFrame) -> list[dict[str, Any]]:
    """Suggested rules as dicts for the rule engine (a few per column)."""
    import json

    rules = []
    for row in suggested.collect():
        if row["type"] == "uniqueness":
            rules.append({"type": "uniqueness", "columns": [row["column"]]})
        elif row["type"] == "range":
            rules.append({"type": "range", "column": row["column"], "min": row["min"], "max": row["max"]})
        elif row["type"] == "format":
            rules.append({"type": "format", "column": row["column"], "format": row["argument"]})
        elif row["type"] == "in_set":
            rules.append({"type": "in_set", "column": row["column"], "values": json.loads(row["argument"])})
        elif row["type"] == "regex":
            rules.append({"type": "regex", "column": row["column"], "pattern": row["argument"]})
        elif row["type"] == "cross_column_comparison":
            rules.append(
                {"type": row["type"], "column1": row["column"], "operator": row["argument"], "column2": row["other_column"]}
            )
        else:
            rules.append({"type": row["type"], "column": row["column"]})
    return rules


def inspect_dataset(df: DataFrame, file_format: str, **options: str) -> DataFrame:
    """Dataset metadata: one row per column with the dataset's figures beside it."""
    if not df.columns:
        raise ValueError("the dataset has no columns")
    if df.isEmpty():
        raise ValueError("the dataset has no data rows")
    # one grouping of the cells serves the distinct counts and the top values
    counts = metrics.value_counts(df)
    top = (
        top_values(df, counts=counts)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("t"))
        .select("column", F.transform("t", lambda x: x["value"]).alias("sample_values"))
    )
    info = metrics.dataset_info(df).select(
        F.lit(1).alias("__one"),
        F.lit(file_format).alias("format"),
        F.lit(",".join(f"{k}={v}" for k, v in sorted(options.items()))).alias("detected_options"),
        F.col("rows").alias("row_count"),
        F.col("columns").alias("column_count"),
    )
    profile = profile_columns(df, counts=counts).join(F.broadcast(top), "column", "left")
    return profile.withColumn("__one", F.lit(1)).join(F.broadcast(info), "__one").drop("__one")
