"""Cleaning of whole datasets.

What depends on the data (empty columns, number columns, date columns) is
decided in one aggregation; the cleaning itself is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.dates import timestamp_from_text
from ..functions.missing import TEXTUAL, is_missing, quoted
from ..functions.numbers import number_from_text, plain_number
from ..functions.text import trim_invisible
from .headers import normalize_headers
from .metrics import same_cells


@dataclass(frozen=True)
class CleanOptions:
    normalize_headers: bool = True
    drop_empty_columns: bool = True
    trim_strings: bool = True
    coerce_numeric: bool = True
    parse_dates: bool = True
    drop_duplicates: bool = False
    date_share: float = 0.5
    # adds <column>__unparsed with the text of date cells that did not parse
    keep_unparsed: bool = False


class Plan(NamedTuple):
    """What one look at the data decided."""

    dropped: list[str]
    numeric: list[str]
    dates: list[str]


class Cleaned(NamedTuple):
    data: DataFrame
    plan: Plan
    report: DataFrame
    totals: DataFrame


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, TEXTUAL)


def _staged(df: DataFrame, options: CleanOptions, numbers: list[str], dates: list[str]) -> DataFrame:
    """Each column next to its cleaned forms: ``t<i>`` text, ``n<i>`` number, ``d<i>`` date.

    Every form is computed in a projection of its own and then only referred
    to, so the regular expressions run once per cell.
    """
    texts = [i for i, c in enumerate(df.columns) if _is_text(df, c)]
    raw = [F.col(quoted(c)).alias(f"r{i}") for i, c in enumerate(df.columns)]
    trim = trim_invisible if options.trim_strings else (lambda c: c)
    staged = df.select(*raw).select("*", *[trim(F.col(f"r{i}")).alias(f"t{i}") for i in texts])
    parsed = [
        *[number_from_text(F.col(f"t{i}")).alias(f"n{i}") for i in texts if df.columns[i] in numbers],
        *[timestamp_from_text(F.col(f"t{i}")).alias(f"d{i}") for i in texts if df.columns[i] in dates],
    ]
    return staged.select("*", *parsed)


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a single value."""
    counts = df.agg(
        *[
            F.count_if(~is_missing(F.col(quoted(f.name)), f.dataType)).alias(str(i))
            for i, f in enumerate(df.schema)
        ]
    ).first()
    return [name for i, name in enumerate(df.columns) if counts[str(i)] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    gone = set(empty_columns(df))
    return df.select(*[F.col(quoted(c)) for c in df.columns if c not in gone])


def decide(df: DataFrame, options: CleanOptions = CleanOptions()) -> Plan:
    """Empty, number and date columns, from one aggregation over all rows.

    A text column becomes a number column when every value reads as a number,
    and a date column when more than ``date_share`` of its values are dates.
    """
    texts = [c for c in df.columns if _is_text(df, c)]
    staged = _staged(
        df, options, texts if options.coerce_numeric else [], texts if options.parse_dates else []
    )
    measures = []
    for i, field in enumerate(df.schema):
        measures.append(F.count_if(~is_missing(F.col(f"r{i}"), field.dataType)).alias(f"present{i}"))
        for form, label in (("t", "texts"), ("n", "numbers"), ("d", "dates")):
            if f"{form}{i}" in staged.columns:
                measures.append(F.count(f"{form}{i}").alias(f"{label}{i}"))
    found = staged.agg(*measures).first().asDict()
    dropped, numeric, dates = [], [], []
    for i, name in enumerate(df.columns):
        texts = found.get(f"texts{i}") or 0
        if options.drop_empty_columns and found[f"present{i}"] == 0:
            dropped.append(name)
        elif texts and found.get(f"numbers{i}") == texts:
            numeric.append(name)
        elif texts and (found.get(f"dates{i}") or 0) / texts > options.date_share:
            dates.append(name)
    return Plan(dropped, numeric, dates)


def _final(staged: DataFrame, df: DataFrame, i: int, plan: Plan) -> Column:
    name = df.columns[i]
    if name in plan.numeric:
        return F.col(f"n{i}")
    if name in plan.dates:
        return F.col(f"d{i}")
    return F.col(f"t{i}" if f"t{i}" in staged.columns else f"r{i}")


def apply_plan(df: DataFrame, plan: Plan, options: CleanOptions = CleanOptions()) -> DataFrame:
    return _chosen(_staged(df, options, plan.numeric, plan.dates), df, plan, options)


def _chosen(staged: DataFrame, df: DataFrame, plan: Plan, options: CleanOptions) -> DataFrame:
    """The cleaned columns of staged rows."""
    columns = []
    for i, name in enumerate(df.columns):
        if name in plan.dropped:
            continue
        columns.append(_final(staged, df, i, plan).alias(name))
        if options.keep_unparsed and name in plan.dates:
            columns.append(F.when(F.col(f"d{i}").isNull(), F.col(f"t{i}")).alias(f"{name}__unparsed"))
    cleaned = staged.select(*columns)
    # NaN and NULL are both missing, the two zeros equal
    return cleaned.select(*same_cells(cleaned)).dropDuplicates() if options.drop_duplicates else cleaned


def cleaning_report(df: DataFrame, plan: Plan, options: CleanOptions = CleanOptions()) -> DataFrame:
    """Per column: nulls before and after, and cells each step changed; one scan.

    ``trimmed`` counts cells whose text really changed, ``made_numeric`` cells
    that read as numbers only after their separators were understood, and
    ``unparsed_dates`` cells of date columns that became NULL.
    """
    staged = _staged(df, options, plan.numeric, plan.dates)
    rows = [F.struct(*[m.alias(n) for n, m in row.items()]) for row in _measures(df, staged, plan)]
    return staged.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def _measures(df: DataFrame, staged: DataFrame, plan: Plan) -> list[dict[str, Column]]:
    """The report of each column as aggregates over the staged rows."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = []
    for i, field in enumerate(df.schema):
        name, raw, final = field.name, F.col(f"r{i}"), _final(staged, df, i, plan)
        trimmed = numbers = parsed = unparsed = zero
        after = is_missing(raw, field.dataType)
        if f"t{i}" in staged.columns:
            text = F.col(f"t{i}")
            trimmed = F.count_if(~raw.eqNullSafe(text))
            after = final.isNull()
            if name in plan.numeric:
                numbers = F.count_if(final.isNotNull() & plain_number(text).isNull())
            if name in plan.dates:
                parsed = F.count(final)
                unparsed = F.count_if(text.isNotNull() & final.isNull())
        rows.append({
            "column": F.lit(name),
            "removed": F.lit(name in plan.dropped),
            "nulls_before": F.count_if(is_missing(raw, field.dataType)),
            "nulls_after": none if name in plan.dropped else F.count_if(after),
            "trimmed": trimmed,
            "made_numeric": numbers,
            "parsed_dates": parsed,
            "unparsed_dates": unparsed,
        })
    return rows


def totals(df: DataFrame, cleaned: DataFrame, plan: Plan) -> DataFrame:
    """Rows and columns before and after."""
    read = df.agg(F.count(F.lit(1)).alias("rows_read"), F.lit(1).alias("__one"))
    written = cleaned.agg(F.count(F.lit(1)).alias("rows_written"), F.lit(1).alias("__one"))
    return read.join(F.broadcast(written), "__one").select(
        "rows_read",
        "rows_written",
        F.lit(len(df.columns)).cast("long").alias("columns_before"),
        F.lit(len(cleaned.columns)).cast("long").alias("columns_after"),
        F.lit(",".join(plan.dropped)).alias("removed_columns"),
    )


def clean_dataset(df: DataFrame, options: CleanOptions = CleanOptions()) -> Cleaned:
    """Headers, empty columns, trimming, numbers, dates, then duplicates."""
    if options.normalize_headers:
        df = normalize_headers(df)
    plan = decide(df, options)
    data = apply_plan(df, plan, options)
    return Cleaned(data, plan, cleaning_report(df, plan, options), totals(df, data, plan))


REPORT = "column string, removed boolean, nulls_before long, nulls_after long, trimmed long, made_numeric long, parsed_dates long, unparsed_dates long"
TOTALS = "rows_read long, rows_written long, columns_before long, columns_after long, removed_columns string"


def write_clean(df: DataFrame, path: str, options: CleanOptions = CleanOptions(), mode: str = "errorifexists") -> Cleaned:
    """``clean_dataset`` written as Parquet, its report and totals counted while the rows are written.

    After the pass that decides about the columns the rows are read once more,
    not again for the report. A task that runs twice counts once.
    """
    if options.normalize_headers:
        df = normalize_headers(df)
    plan = decide(df, options)
    staged = _staged(df, options, plan.numeric, plan.dates)
    measures = _measures(df, staged, plan)
    # what holds for a column whatever its rows is no aggregate
    counted = {(i, n): m for i, row in enumerate(measures) for n, m in row.items() if n not in ("column", "removed")}
    before, after = Observation(), Observation()
    seen = staged.observe(before, F.count(F.lit(1)).alias("rows"), *[F.max(F.lit(None).cast("long")).alias(f"{n}_{i}") if _constant(n, i, df, plan) else m.alias(f"{n}_{i}") for (i, n), m in counted.items()])
    data = _chosen(seen, df, plan, options)
    data.observe(after, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    spark, found = df.sparkSession, before.get
    rows = []
    for i, name in enumerate(df.columns):
        values = [found[f"{n}_{i}"] for n in ("nulls_before", "nulls_after", "trimmed", "made_numeric", "parsed_dates", "unparsed_dates")]
        rows.append((name, name in plan.dropped, *[v if v is not None or n == 1 else 0 for n, v in enumerate(values)]))
    total = [(found["rows"], after.get["rows"], len(df.columns), len(data.columns), ",".join(plan.dropped))]
    return Cleaned(spark.read.schema(data.schema).parquet(path), plan, spark.createDataFrame(rows, REPORT), spark.createDataFrame(total, TOTALS))


def _constant(measure: str, i: int, df: DataFrame, plan: Plan) -> bool:
    """Whether a count of the report does not look at the rows."""
    name = df.columns[i]
    if measure == "nulls_before":
        return False
    if measure == "nulls_after":
        return name in plan.dropped
    needed = {"trimmed": True, "made_numeric": name in plan.numeric, "parsed_dates": name in plan.dates, "unparsed_dates": name in plan.dates}
    return not (needed[measure] and _is_text(df, name))
