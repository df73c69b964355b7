"""Rule validation: all row rules of a rule set are counted in one pass.

A rule is a plain dict, so a rule set can be kept as JSON::

    {"type": "not_null", "column": c}
    {"type": "uniqueness", "columns": [c, ...]}
    {"type": "format", "column": c, "format": "YYYY-MM-DD" or a regex}
    {"type": "range", "column": c, "min": x, "max": y}
    {"type": "in_set", "column": c, "values": [...]}
    {"type": "regex", "column": c, "pattern": p}
    {"type": "value_distribution", "column": c, "value": v, "min_freq": x, "max_freq": y}
    {"type": "cross_column_comparison", "column1": a, "operator": op, "column2": b}

and, described only in the documents of the original:

    {"type": "custom", "column": c, "name": n, "predicate": f}  f: pandas Series -> boolean Series
    {"type": "preset", "column": c, "preset": "email" or "phone"}
    {"type": "conditional", "when": SQL condition, "then": [row rules]}
    {"type": "foreign_key", "column": c, "reference": name, "reference_column": k}
    {"type": "schema", "column": c, "dtype": SQL type the value must be readable as}

In results with one line per row a uniqueness rule is broken by every row of a
group of equal keys, and a foreign key by every row without a partner. A
distribution speaks of no row: results per row refuse it, as they refuse rules
on columns that are not there.

NULL never violates a comparison, set or pattern rule.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import RULE_DATE_FORMATS, unreadable_date
from ..functions.missing import NUMERIC, TEXTUAL, quoted

Rule = Mapping[str, Any]

COMPARISONS = {
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "==": operator.eq,
    "!=": operator.ne,
}

# Patterns for e-mail addresses and phone numbers.
PRESETS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?1?-?\d{3}-?\d{3}-?\d{4}$",
}

# Problem types of labelled data, by the rule type that finds them.
PROBLEM_TYPES = {
    "not_null": "NULL_VALUE",
    "uniqueness": "DUPLICATE",
    "range": "OUT_OF_RANGE",
    "format": "INVALID_FORMAT",
    "regex": "INVALID_FORMAT",
    "preset": "INVALID_FORMAT",
    "in_set": "INVALID_FORMAT",
    "cross_column_comparison": "INCONSISTENT",
    "conditional": "INCONSISTENT",
    "foreign_key": "MISSING_FK",
    "schema": "WRONG_TYPE",
}

ROW_RULES = {
    "not_null",
    "format",
    "range",
    "in_set",
    "regex",
    "cross_column_comparison",
    "custom",
    "preset",
    "conditional",
    "schema",
}
# rules that need the other rows, or another table, to tell whether a row breaks them
SET_RULES = {"uniqueness", "foreign_key"}


class RowCheck(NamedTuple):
    """A rule that one row alone can violate."""

    name: str
    type: str
    column: str
    violation: Column


def rule_columns(rule: Rule) -> list[str]:
    kind = rule["type"]
    if kind == "uniqueness":
        return list(rule.get("columns") or [])
    if kind == "cross_column_comparison":
        return [rule["column1"], rule["column2"]]
    if kind == "conditional":
        return [c for inner in rule["then"] for c in rule_columns(inner)]
    return [rule["column"]]


def rule_name(rule: Rule) -> str:
    if rule.get("name"):
        return rule["name"]
    kind = rule["type"]
    target = "_".join(rule_columns(rule))
    if kind == "not_null":
        return f"null_{target}"
    if kind == "format":
        dated = rule["format"].upper() in RULE_DATE_FORMATS
        return f"date_format_{target}" if dated else f"format_{target}"
    if kind == "value_distribution":
        return f"distribution_{target}_{rule['value']}"
    if kind == "cross_column_comparison":
        return f"cross_column_{rule['column1']}_{rule['operator']}_{rule['column2']}"
    if kind == "preset":
        return f"{rule['preset']}_{target}"
    return f"{kind}_{target}"


def is_effective(rule: Rule) -> bool:
    """Rules without their argument (bounds, pattern, columns) are ignored."""
    kind = rule["type"]
    if kind == "uniqueness":
        return bool(rule.get("columns"))
    if kind == "format":
        return bool(rule.get("format"))
    if kind == "regex":
        return bool(rule.get("pattern"))
    if kind == "range":
        return rule.get("min") is not None or rule.get("max") is not None
    return True


def _as_number(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, NUMERIC):
        return column
    return column.try_cast("double")


def _comparable(left: str, right: str, types: Mapping[str, T.DataType]) -> tuple[Column, Column]:
    """Text compared with another type is read as that type; unreadable text is NULL."""
    a, b = F.col(quoted(left)), F.col(quoted(right))
    ta, tb = types[left], types[right]
    if isinstance(ta, TEXTUAL) and not isinstance(tb, TEXTUAL):
        return a.try_cast(tb), b
    if isinstance(tb, TEXTUAL) and not isinstance(ta, TEXTUAL):
        return a, b.try_cast(ta)
    return a, b


def _series_check(predicate: Callable[[pd.Series], pd.Series]) -> Callable:
    """The predicate, for the values present, with the hints that mark it as value by value."""

    def check(values: pd.Series) -> pd.Series:
        present = values.notna()
        if present.all():
            return predicate(values)
        return predicate(values[present]).reindex(values.index, fill_value=True)

    # spelled out: the hints of a module with postponed annotations are text
    check.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return check


def _raw_violation(rule: Rule, types: Mapping[str, T.DataType]) -> Column:
    kind = rule["type"]
    if kind == "conditional":
        inner = [violation(r, types) for r in rule["then"] if is_effective(r)]
        broken = F.lit(False)
        for part in inner:
            broken = broken | part
        return F.expr(rule["when"]) & broken
    if kind == "cross_column_comparison":
        if rule["operator"] not in COMPARISONS:
            raise ValueError(f"unknown comparison operator {rule['operator']!r}")
        a, b = _comparable(rule["column1"], rule["column2"], types)
        return ~COMPARISONS[rule["operator"]](a, b)

    name = rule["column"]
    column, dtype = F.col(quoted(name)), types[name]
    if kind == "not_null":
        return column.isNull()
    if kind == "format":
        pattern = RULE_DATE_FORMATS.get(rule["format"].upper())
        if pattern is None:
            return ~column.cast("string").rlike(rule["format"])
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(False)
        return unreadable_date(column.cast("string"), pattern)
    if kind == "range":
        number = _as_number(column, dtype)
        outside = F.lit(False)
        if rule.get("min") is not None:
            outside = outside | (number < F.lit(float(rule["min"])))
        if rule.get("max") is not None:
            outside = outside | (number > F.lit(float(rule["max"])))
        return outside
    if kind == "in_set":
        return ~column.cast("string").isin([str(v) for v in rule["values"]])
    if kind == "regex":
        return ~column.cast("string").rlike(rule["pattern"])
    if kind == "preset":
        return ~column.cast("string").rlike(PRESETS[rule["preset"]])
    if kind == "schema":
        wanted = column.try_cast(rule["dtype"])
        return column.isNotNull() & wanted.isNull()
    if kind == "custom":
        holds = F.pandas_udf(_series_check(rule["predicate"]), T.BooleanType())
        # a NULL would turn whole numbers into floats on the way to pandas
        filled = F.coalesce(column, F.lit(0).cast(dtype)) if isinstance(dtype, NUMERIC) else column
        return column.isNotNull() & ~holds(filled)
    raise ValueError(f"{kind!r} is not a row rule")


def violation(rule: Rule, types: Mapping[str, T.DataType]) -> Column:
    """TRUE for violating rows, FALSE for all others (never NULL)."""
    return F.coalesce(_raw_violation(rule, types), F.lit(False))


def column_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema}


def _applicable(df: DataFrame, rule: Rule) -> bool:
    return all(c in df.columns for c in rule_columns(rule))


def named_rules(df: DataFrame, rules: Iterable[Rule], kinds: Iterable[str]) -> list[Rule]:
    """The effective rules, each under a name of its own; rules that cannot label a row are refused."""
    named: list[Rule] = []
    taken: dict[str, int] = {}
    for rule in rules:
        if not is_effective(rule):
            continue
        if rule["type"] not in kinds:
            raise ValueError(f"a {rule['type']!r} rule cannot label a row here: {rule_name(rule)}")
        if not _applicable(df, rule):
            raise ValueError(f"rule {rule_name(rule)} needs columns that are not there: {rule_columns(rule)}")
        name = rule_name(rule)
        taken[name] = taken.get(name, 0) + 1
        named.append({**rule, "name": name if taken[name] == 1 else f"{name}_{taken[name]}"})
    return named


def row_checks(df: DataFrame, rules: Iterable[Rule]) -> list[RowCheck]:
    """The checks of rules that one row alone can break; other kinds are refused."""
    types = column_types(df)
    return [
        RowCheck(rule_name(r), r["type"], ",".join(rule_columns(r)), violation(r, types))
        for r in named_rules(df, rules, ROW_RULES)
    ]


def failing_rows(df: DataFrame, rule: Rule) -> DataFrame:
    """The rows that violate one row rule."""
    return df.filter(violation(rule, column_types(df)))


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Groups of equal rows (NULLs are equal) with more than one member."""
    columns = columns or df.columns
    groups = df.groupBy(*[F.col(quoted(c)) for c in columns]).agg(F.count(F.lit(1)).alias("count"))
    return groups.filter("count > 1")


def duplicate_rate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, distinct rows and (rows - distinct) / rows."""
    columns = columns or df.columns
    groups = df.groupBy(*[F.col(quoted(c)) for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
    )
    rate = F.try_divide((F.col("rows") - F.col("distinct_rows")).cast("double"), F.col("rows"))
    return totals.withColumn("duplicate_rate", F.round(F.coalesce(rate, F.lit(0.0)), 6))


def broken_references(
    df: DataFrame, column: str, reference: DataFrame, reference_column: str
) -> DataFrame:
    """Foreign-key values without a partner and how many rows carry each.

    Rows are counted per value before the join, so a value held by many rows
    reaches the join once.
    """
    keys = (
        df.filter(F.col(quoted(column)).isNotNull())
        .groupBy(F.col(quoted(column)).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    known = reference.select(F.col(quoted(reference_column)).alias("value"))
    return keys.join(known, "value", "left_anti")


_RESULT = "rule string, type string, column string, failed_count bigint, duplicate_rows bigint, frequency double, status string"


def _result(rule, kind, column, failed, duplicates, frequency, status) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(kind).alias("type"),
        F.lit(column).alias("column"),
        failed.cast("long").alias("failed_count"),
        duplicates.cast("long").alias("duplicate_rows"),
        frequency.cast("double").alias("frequency"),
        status.alias("status"),
    )


def _verdict(failed: Column) -> Column:
    return F.when(failed > 0, F.lit("FAILED")).otherwise(F.lit("PASSED"))


def _frequency_rule(rule: Rule, dtype: T.DataType, total: Column) -> Column:
    name = rule["column"]
    wanted = F.lit(str(rule["value"])).try_cast(dtype)
    share = F.try_divide(F.count_if(F.col(quoted(name)) == wanted).cast("double"), total)
    inside = share.between(float(rule["min_freq"]), float(rule["max_freq"]))
    status = F.when(total == 0, "WARNING").when(inside, "PASSED").otherwise("FAILED")
    failed = F.when(~inside, F.lit(1)).otherwise(F.lit(0))
    null = F.lit(None)
    return _result(rule_name(rule), rule["type"], name, failed, null, share, status)


def rules_summary(
    df: DataFrame,
    rules: list[Rule],
    references: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One result row per rule.

    Row rules and distributions share one scan; a uniqueness or foreign-key
    rule adds one grouped scan over its own columns. A distribution reports
    its frequency, the other rules a count (uniqueness: duplicate groups).
    """
    references = references or {}
    types = column_types(df)
    null = F.lit(None)
    total = F.count(F.lit(1))
    fused: list[Column] = []
    grouped: list[DataFrame] = []

    for rule in rules:
        if not is_effective(rule):
            continue
        name, kind, shown = rule_name(rule), rule["type"], ",".join(rule_columns(rule))
        if not _applicable(df, rule):
            fused.append(_result(name, kind, shown, null, null, null, F.lit("SKIPPED")))
        elif kind == "value_distribution":
            fused.append(_frequency_rule(rule, types[rule["column"]], total))
        elif kind == "uniqueness":
            groups = duplicate_groups(df, rule_columns(rule))
            failed = F.count(F.lit(1))
            rows = F.coalesce(F.sum("count"), F.lit(0))
            grouped.append(
                groups.agg(
                    F.array(_result(name, kind, shown, failed, rows, null, _verdict(failed))).alias("r")
                )
            )
        elif kind == "foreign_key":
            broken = broken_references(
                df, rule["column"], references[rule["reference"]], rule["reference_column"]
            )
            failed = F.coalesce(F.sum("rows"), F.lit(0))
            grouped.append(
                broken.agg(
                    F.array(_result(name, kind, shown, failed, null, null, _verdict(failed))).alias("r")
                )
            )
        else:
            failed = F.count_if(violation(rule, types))
            fused.append(_result(name, kind, shown, failed, null, null, _verdict(failed)))

    parts = [df.agg(F.array(*fused).alias("r"))] if fused else []
    parts += grouped
    if not parts:
        return df.sparkSession.createDataFrame([], _RESULT)
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    return results.select(F.inline("r"))


def _marked(df: DataFrame, rule: Rule, references: Mapping[str, DataFrame], mark: str) -> DataFrame:
    """Adds ``mark``: whether the row breaks a rule about the whole set.

    Keys are grouped first, so only the broken ones are joined back. Both sides
    of the join are plain exchanges, which adaptive execution splits where one
    key holds very many rows.
    """
    columns = rule_columns(rule)
    if rule["type"] == "uniqueness":
        broken = duplicate_groups(df, columns).drop("count")
    else:
        reference = references.get(rule["reference"])
        if reference is None:
            raise ValueError(f"rule {rule_name(rule)} needs the table {rule['reference']!r}")
        broken = broken_references(df, rule["column"], reference, rule["reference_column"]).select(F.col("value").alias(columns[0]))
    keys = [f"{mark}_{i}" for i in range(len(columns))]
    broken = broken.select(*[F.col(quoted(c)).alias(k) for c, k in zip(columns, keys)], F.lit(True).alias(mark))
    same = [F.col(quoted(c)).eqNullSafe(F.col(k)) for c, k in zip(columns, keys)]
    return df.join(broken, reduce(operator.and_, same), "left").drop(*keys)


def with_violations(
    df: DataFrame, rules: Iterable[Rule], name: str = "violations", references: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Adds the names of the rules each row breaks; equal names are numbered."""
    types = column_types(df)
    flagged, labels, marks = df, [], []
    for number, rule in enumerate(named_rules(df, rules, ROW_RULES | SET_RULES)):
        if rule["type"] in SET_RULES:
            marks.append(f"__rule_{number}")
            flagged = _marked(flagged, rule, references or {}, marks[-1])
            broken = F.coalesce(F.col(marks[-1]), F.lit(False))
        else:
            broken = violation(rule, types)
        labels.append(F.when(broken, F.lit(rule["name"])))
    if not labels:
        return df.withColumn(name, F.array().cast("array<string>"))
    return flagged.withColumn(name, F.array_compact(F.array(*labels))).drop(*marks)


def rule_failure_samples(
    df: DataFrame, rules: Iterable[Rule], order_by: list[str], per_rule: int = 5, references: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """The first failing rows of every rule.

    The rank limit is applied inside each input partition before the shuffle,
    so a rule that fails for most rows ships only a few of them.
    """
    flagged = with_violations(df, rules, "__broken", references).filter(F.size("__broken") > 0)
    exploded = flagged.select(F.explode("__broken").alias("rule"), *[F.col(quoted(c)) for c in df.columns])
    ranked = exploded.withColumn(
        "sample_no",
        F.row_number().over(Window.partitionBy("rule").orderBy(*[F.col(quoted(c)) for c in order_by])),
    )
    return ranked.filter(F.col("sample_no") <= per_rule)


def valid_subset(
    df: DataFrame, rules: Iterable[Rule], distinct_on: list[str] | None = None, references: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Rows that pass every rule, then one row per key if keys are given.

    Which of several equal-key rows stays is settled by the smallest row, and
    the aggregate combines on the map side, so a frequent key is no hot task.
    """
    valid = with_violations(df, rules, "__broken", references).filter(F.size("__broken") == 0).drop("__broken")
    if not distinct_on:
        return valid
    return first_per_key(valid, distinct_on, [c for c in df.columns if c not in distinct_on])


def first_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key in the given order, combined map-side."""
    rest = order_by + [c for c in df.columns if c not in keys and c not in order_by]
    first = F.min(F.struct(*[F.col(quoted(c)) for c in rest]))
    best = df.groupBy(*[F.col(quoted(c)) for c in keys]).agg(first.alias("__row"))
    return best.select(
        *[F.col(quoted(c)) if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns]
    )


VALID, QUARANTINE = "valid", "quarantine"


def rows_by_reason(df: DataFrame, rules: Iterable[Rule], references: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Each row once per broken rule with ``verdict`` quarantine and its ``reason``; clean rows once as valid, without one.

    Ready for ``write.partitionBy("verdict", "reason")``.
    """
    flagged = with_violations(df, rules, "__broken", references)
    verdict = F.when(F.col("__reason").isNull(), VALID).otherwise(QUARANTINE)
    rows = flagged.select(F.explode_outer("__broken").alias("__reason"), *[F.col(quoted(c)) for c in df.columns])
    return rows.select(verdict.alias("verdict"), F.col("__reason").alias("reason"), *[F.col(quoted(c)) for c in df.columns])


def quarantine_split(
    df: DataFrame, rules: Iterable[Rule], references: Mapping[str, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, one quarantined row per broken rule with its ``reason``)."""
    rows = rows_by_reason(df, rules, references)
    return (
        rows.filter(F.col("verdict") == VALID).drop("verdict", "reason"),
        rows.filter(F.col("verdict") == QUARANTINE).drop("verdict"),
    )


def null_or_blank(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column, the cells that are NULL or the empty text."""
    columns = columns or df.columns
    types = column_types(df)

    def bad(name: str) -> Column:
        column = F.col(quoted(name))
        if isinstance(types[name], TEXTUAL):
            return F.coalesce(column == "", F.lit(True))
        return column.isNull()

    rows = [
        F.struct(F.lit(c).alias("column"), F.count_if(bad(c)).alias("null_or_blank")) for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def timeliness(df: DataFrame, column: str, reference_time: str, days: int) -> DataFrame:
    """Share of rows at most ``days`` old at the reference time."""
    limit = F.expr(f"TIMESTAMP_NTZ '{reference_time}' - INTERVAL '{int(days)}' DAY")
    stamp = F.col(quoted(column)).cast("timestamp_ntz")
    recent = F.count_if(stamp >= limit)
    total = F.count(F.lit(1))
    share = F.coalesce(F.try_divide(recent * F.lit(100.0), total), F.lit(0.0))
    return df.agg(
        total.alias("rows"),
        recent.alias("recent_rows"),
        F.round(share, 2).alias("timeliness"),
    )


def detected_problems(
    df: DataFrame, rules: Iterable[Rule], row_key: str, references: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """(row_key, problem_type) of every row that breaks a rule; a rule without a problem type is refused."""
    rules = [r for r in rules if is_effective(r)]
    if unknown := [r["type"] for r in rules if r["type"] not in PROBLEM_TYPES]:
        raise ValueError(f"no problem type for rules of type {sorted(set(unknown))}")
    # names are numbered, so the type follows from the rule, not from its label
    named = named_rules(df, rules, ROW_RULES | SET_RULES)
    types = F.create_map(*[F.lit(x) for r in named for x in (r["name"], PROBLEM_TYPES[r["type"]])]) if named else None
    flagged = with_violations(df, named, "__found", references)
    if types is None:
        return flagged.select(F.col(quoted(row_key)), F.explode("__found").alias("problem_type"))
    found = F.array_distinct(F.transform("__found", lambda n: types[n]))
    return flagged.select(F.col(quoted(row_key)), F.explode(found).alias("problem_type"))


def detection_quality(expected: DataFrame, detected: DataFrame, row_key: str) -> DataFrame:
    """Precision and recall of detected against labelled problems, per type.

    Both inputs carry (row_key, problem_type). They are stacked and grouped,
    which needs one shuffle and ignores repeated findings.
    """
    cols = [F.col(quoted(row_key)).alias("row_key"), F.col("problem_type")]
    stacked = expected.select(*cols, F.lit(1).alias("e"), F.lit(0).alias("d")).unionByName(
        detected.select(*cols, F.lit(0).alias("e"), F.lit(1).alias("d"))
    )
    pairs = stacked.groupBy("row_key", "problem_type").agg(F.max("e").alias("e"), F.max("d").alias("d"))
    counts = pairs.groupBy("problem_type").agg(
        F.sum(F.col("e") * F.col("d")).cast("long").alias("true_positives"),
        F.sum((1 - F.col("e")) * F.col("d")).cast("long").alias("false_positives"),
        F.sum(F.col("e") * (1 - F.col("d"))).cast("long").alias("false_negatives"),
    )
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return counts.withColumn(
        "precision", F.round(F.coalesce(F.try_divide(tp * F.lit(1.0), tp + fp), F.lit(0.0)), 4)
    ).withColumn("recall", F.round(F.coalesce(F.try_divide(tp * F.lit(1.0), tp + fn), F.lit(0.0)), 4))
