"""Compare a target table with a trusted one and correct it.

Both sides are reduced to one row per normalised key before they meet, so the
full outer join is one to one and no key can flood a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import NUMERIC, TEXTUAL, quoted
from ..functions.numbers import number_from_text, plain_number
from ..functions.text import normalize_key
from .headers import normalize_headers, normalize_name


@dataclass(frozen=True)
class Options:
    normalize_keys: bool = True
    lowercase: bool = True
    strip_accents: bool = True
    strip_punctuation: bool = True
    coerce_numeric: bool = True
    decimal_places: int = 2
    tolerance: float = 0.0
    null_equals_zero: bool = True
    duplicate_policy: str = "keep_last"
    order_by: list[str] = field(default_factory=list)
    # "inline": the job fails on a repeated trusted key; "eager": a pass of its
    # own lists the repeated keys first; "off": the keys are known to be distinct
    check_gold: str = "inline"


class Reconciliation(NamedTuple):
    """Lazy results; each reads the columns it needs."""

    joined: DataFrame
    summary: DataFrame
    diffs: DataFrame
    corrected: DataFrame


def key_columns(df: DataFrame, keys: list[str], options: Options = Options()) -> DataFrame:
    """Adds ``__k0``, ``__k1``... with the normalised key values."""
    for i, key in enumerate(keys):
        column = F.col(quoted(key))
        if options.normalize_keys:
            value = normalize_key(
                column, options.lowercase, options.strip_accents, options.strip_punctuation
            )
        else:
            value = F.coalesce(column.cast("string"), F.lit(""))
        df = df.withColumn(f"__k{i}", value)
    return df


def composite_key(df: DataFrame, keys: list[str], options: Options = Options()) -> DataFrame:
    """Adds ``composite_key``: the normalised values joined with ``||``."""
    keyed = key_columns(df, keys, options)
    names = [f"__k{i}" for i in range(len(keys))]
    return keyed.withColumn("composite_key", F.concat_ws("||", *names)).drop(*names)


def gold_duplicate_keys(gold: DataFrame, keys: list[str], options: Options = Options()) -> DataFrame:
    """Keys that occur more than once on the trusted side, with their counts."""
    keyed = composite_key(gold, keys, options)
    counts = keyed.groupBy("composite_key").agg(F.count(F.lit(1)).alias("count"))
    return counts.filter("count > 1")


def check_gold(gold: DataFrame, keys: list[str], options: Options = Options()) -> None:
    """Raises with five repeated keys and their number, if there are any."""
    duplicates = gold_duplicate_keys(gold, keys, options)
    first = [r[0] for r in duplicates.orderBy("composite_key").limit(5).collect()]
    if first:
        total = duplicates.count()
        raise ValueError(f"Duplicate keys found in GOLD dataset: {first}... ({total} total)")


def _distinct_or_fail(trusted: DataFrame, names: list[str]) -> DataFrame:
    """The same rows; running them fails if a key occurs twice.

    The grouping is by the join key, so it adds no shuffle to the join.
    """
    values = [c for c in trusted.columns if c not in names]
    grouped = trusted.groupBy(*names).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.max(quoted(v)).alias(v) for v in values]
    )
    message = F.concat(F.lit("Duplicate keys found in GOLD dataset: "), F.concat_ws("||", *names))
    failed = F.raise_error(message).cast("boolean")
    return grouped.filter(F.when(F.col("__rows") == 1, True).otherwise(failed)).drop("__rows")


def _number(df: DataFrame, name: str, options: Options) -> Column:
    column, dtype = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(dtype, NUMERIC):
        value = column.cast("double")
    elif isinstance(dtype, TEXTUAL):
        value = number_from_text(column) if options.coerce_numeric else plain_number(column)
    else:
        value = plain_number(column.cast("string"))
    return F.when(~F.isnan(value), value)


def merge_duplicates(
    df: DataFrame, keys: list[str], values: list[str], options: Options = Options()
) -> DataFrame:
    """One target row per normalised key.

    ``keep_last`` keeps the row that is last in ``order_by``; ``sum`` and
    ``mean`` aggregate the value columns and keep the keys. An unknown policy
    means ``keep_last``. All of them combine on the map side.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    policy = options.duplicate_policy if values else "keep_last"
    if policy in ("sum", "mean"):
        combine = F.sum if policy == "sum" else F.avg
        originals = F.min(F.struct(*[F.col(quoted(k)) for k in keys]))
        total = lambda v: F.coalesce(combine(quoted(v)), F.lit(0.0)) if policy == "sum" else combine(quoted(v))
        merged = df.groupBy(*names).agg(
            originals.alias("__keys"), *[total(v).alias(v) for v in values]
        )
        return merged.select(
            *names, *[F.col("__keys").getField(k).alias(k) for k in keys], *[F.col(quoted(v)) for v in values]
        )
    if not options.order_by:
        raise ValueError("keep_last needs order_by: rows of a table have no order of their own")
    # values and keys first: the choice among equal rows is the same whether or not the other columns are read
    rest = [c for c in dict.fromkeys(values + keys + df.columns) if c not in names]
    # the whole row settles ties, so the choice never depends on the layout
    order = [F.col(quoted(c)).alias(f"o{i}") for i, c in enumerate(options.order_by)]
    last = F.max(F.struct(*order, F.struct(*[F.col(quoted(c)) for c in rest]).alias("row")))
    kept = df.groupBy(*names).agg(last.alias("__last"))
    return kept.select(*names, *[F.col("__last.row").getField(c).alias(c) for c in df.columns if c not in names])


def _prepared(df: DataFrame, keys: list[str], values: list[str], side: str) -> DataFrame:
    named = normalize_headers(df, distinct=False)
    for column in keys + values:
        if column not in named.columns:
            raise ValueError(f"Column '{column}' not found in {side} dataset")
    return named


def mismatch(target: Column, gold: Column, tolerance: float, null_equals_zero: bool = True) -> Column:
    """True where the two differ by more than the tolerance (infinities by sign)."""
    if null_equals_zero:
        t, g = F.coalesce(target, F.lit(0.0)), F.coalesce(gold, F.lit(0.0))
        return ~((t == g) | (F.abs(t - g) <= tolerance))
    close = (target == gold) | (F.abs(target - gold) <= tolerance)
    both_null = target.isNull() & gold.isNull()
    return ~(both_null | F.coalesce(close, F.lit(False)))


def reconcile(
    gold: DataFrame,
    target: DataFrame,
    keys: list[str],
    values: list[str],
    options: Options = Options(),
) -> Reconciliation:
    """Join, compare, report and correct.

    Summary and differences read keys, values and the order columns of the
    target only; the joined and the corrected rows read all of them.
    """
    keys = [normalize_name(k) for k in keys]
    values = [normalize_name(v) for v in values]
    gold = _prepared(gold, keys, values, "GOLD")
    target = _prepared(target, keys, values, "TARGET")
    names = [f"__k{i}" for i in range(len(keys))]

    if options.check_gold == "eager":
        check_gold(gold, keys, options)

    for v in values:
        target = target.withColumn(v, _number(target, v, options))
    trusted = key_columns(gold, keys, options).select(
        *names, *[_number(gold, v, options).alias(f"__g_{v}") for v in values]
    )
    if options.check_gold == "inline":
        trusted = _distinct_or_fail(trusted, names)
    trusted = trusted.withColumn("__in_gold", F.lit(True))

    def joined_with(rows: DataFrame) -> DataFrame:
        single = merge_duplicates(key_columns(rows, keys, options), keys, values, options)
        both_sides = single.withColumn("__in_target", F.lit(True)).join(trusted, names, "full_outer")
        return both_sides.withColumn(
            "origin",
            F.when(F.col("__in_gold") & F.col("__in_target"), "both")
            .when(F.col("__in_target"), "extra_in_target")
            .otherwise("missing_in_target"),
        ).drop("__in_gold", "__in_target")

    joined = joined_with(target)
    columns = [c for c in joined.columns if c not in names and c != "origin" and not c.startswith("__g_")]
    needed = [c for c in dict.fromkeys(keys + values + list(options.order_by)) if c in target.columns]
    compared = joined_with(target.select(*[F.col(quoted(c)) for c in needed]))

    both = F.col("origin") == "both"
    wrong = {
        v: both
        & mismatch(F.col(quoted(v)), F.col(quoted(f"__g_{v}")), options.tolerance, options.null_equals_zero)
        for v in values
    }
    fixed = {v: F.round(F.col(quoted(f"__g_{v}")), options.decimal_places) for v in values}

    return Reconciliation(
        joined=joined,
        summary=_summary(compared, wrong),
        diffs=_diffs(compared, keys, wrong, fixed),
        corrected=joined.filter(F.col("origin") != "missing_in_target").select(
            *[
                F.when(wrong[c], fixed[c]).otherwise(F.col(quoted(c))).alias(c) if c in wrong else F.col(quoted(c))
                for c in columns
            ]
        ),
    )


def _summary(joined: DataFrame, wrong: dict[str, Column]) -> DataFrame:
    origin = F.col("origin")
    common = F.count_if(origin == "both")
    mismatches = reduce(lambda a, b: a + b, [F.count_if(w) for w in wrong.values()], F.lit(0).cast("long"))
    compared = common * len(wrong)
    accuracy = F.try_divide((compared - mismatches).cast("double"), compared)
    return joined.agg(
        F.count_if(origin != "extra_in_target").alias("rows_gold"),
        F.count_if(origin != "missing_in_target").alias("rows_target"),
        common.alias("common_keys"),
        F.count_if(origin == "missing_in_target").alias("missing_in_target"),
        F.count_if(origin == "extra_in_target").alias("extra_in_target"),
        mismatches.alias("mismatches_total"),
        F.round(F.coalesce(accuracy, F.lit(0.0)), 4).alias("accuracy"),
    )


def _diffs(joined, keys, wrong, fixed) -> DataFrame:
    """One row per wrong cell; the keys are the target's own spelling."""
    cells = [
        F.when(
            wrong[v],
            F.struct(
                F.lit(v).alias("column"),
                F.col(quoted(f"__g_{v}")).alias("gold"),
                F.col(quoted(v)).alias("target"),
                fixed[v].alias("corrected"),
                F.abs(F.col(quoted(f"__g_{v}")) - F.col(quoted(v))).alias("delta"),
            ),
        )
        for v in wrong
    ]
    own_keys = F.struct(*[F.col(quoted(k)) for k in keys]).alias("keys")
    return joined.filter(F.col("origin") == "both").select(own_keys, F.inline(F.array_compact(F.array(*cells))))


def flat_diffs(diffs: DataFrame) -> DataFrame:
    """Key fields as columns of their own."""
    return diffs.select("keys.*", *[c for c in diffs.columns if c != "keys"])


def diff_top_n(diffs: DataFrame, n: int = 100) -> DataFrame:
    """The bounded part of the differences that a report shows."""
    return diffs.orderBy("keys", "column").limit(n)
