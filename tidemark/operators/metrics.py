"""Quality metrics: completeness, uniqueness, validity, consistency and the score.

``column_facts`` gathers everything that needs the values in one aggregation;
the metrics are arithmetic on its one row per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import FLOATING, INTEGRAL, NUMERIC, TEXTUAL, is_missing, null_if_missing, quoted
from ..functions.text import strip_spaces
from ..session import cut_lineage
from .median import exact_medians

THRESHOLD = 80.0


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, INTEGRAL):
        return "integer"
    if isinstance(dtype, FLOATING + (T.DecimalType,)):
        return "float"
    if isinstance(dtype, TEXTUAL):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return dtype.simpleString()


def _percent(part: Column, whole: Column) -> Column:
    share = F.try_divide(part * F.lit(100.0), whole)
    return F.round(F.coalesce(share, F.lit(0.0)), 2)


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column from one scan: counts, invalid cells, text lengths."""
    rows = []
    for field in df.schema:
        column = F.col(quoted(field.name))
        missing = is_missing(column, field.dataType)
        invalid = F.lit(0).cast("long")
        length_std = length_mean = F.lit(None).cast("double")
        if isinstance(field.dataType, FLOATING):
            invalid = F.count_if(F.abs(column) == F.lit(float("inf")))
        elif isinstance(field.dataType, TEXTUAL):
            invalid = F.count_if(strip_spaces(column) == "")
            length_std = F.stddev_samp(F.length(column))
            length_mean = F.avg(F.length(column))
        rows.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(type_class(field.dataType)).alias("data_type"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(missing).alias("missing"),
                invalid.alias("invalid"),
                length_std.alias("length_std"),
                length_mean.alias("length_mean"),
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def completeness_columns(facts: DataFrame) -> DataFrame:
    present = F.col("rows") - F.col("missing")
    return facts.select(
        "column",
        _percent(present, F.col("rows")).alias("completeness"),
        F.col("missing").alias("missing_count"),
        F.col("rows").alias("total_count"),
    )


def completeness_overall(facts: DataFrame) -> DataFrame:
    cells, missing = F.sum("rows"), F.sum("missing")
    return facts.agg(
        _percent(cells - missing, cells).alias("overall_completeness"),
        cells.cast("long").alias("total_cells"),
        missing.cast("long").alias("missing_cells"),
        (cells - missing).cast("long").alias("filled_cells"),
    )


def validity_columns(facts: DataFrame) -> DataFrame:
    present = F.col("rows") - F.col("missing")
    return facts.select(
        "column",
        _percent(present - F.col("invalid"), present).alias("validity"),
        (present - F.col("invalid")).alias("valid_count"),
        F.col("invalid").alias("invalid_count"),
        present.alias("total_count"),
    )


def validity_overall(facts: DataFrame) -> DataFrame:
    cells, invalid = F.sum(F.col("rows") - F.col("missing")), F.sum("invalid")
    return facts.agg(
        _percent(cells - invalid, cells).alias("overall_validity"),
        cells.cast("long").alias("total_cells"),
        (cells - invalid).cast("long").alias("valid_cells"),
        invalid.cast("long").alias("invalid_cells"),
    )


def _consistency() -> Column:
    """Text scores by the spread of its lengths; other types are consistent."""
    spread = F.coalesce(F.try_divide(F.coalesce("length_std", F.lit(0.0)), F.col("length_mean")), F.lit(0.0))
    score = F.when(F.col("data_type") == "text", F.lit(100.0) - spread * 10).otherwise(F.lit(100.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2)


def consistency_columns(facts: DataFrame) -> DataFrame:
    """Columns without any value have no score."""
    return facts.filter(F.col("rows") > F.col("missing")).select(
        "column", _consistency().alias("consistency"), "data_type"
    )


def consistency_overall(facts: DataFrame) -> DataFrame:
    return consistency_columns(facts).agg(
        F.round(F.coalesce(F.avg("consistency"), F.lit(0.0)), 2).alias("overall_consistency")
    )


def _uniqueness(total: Column, unique: Column) -> list[Column]:
    return [
        _percent(unique, total).alias("overall_uniqueness"),
        total.alias("total_rows"),
        unique.alias("unique_rows"),
        (total - unique).alias("duplicate_rows"),
    ]


def row_uniqueness(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows count as duplicates; NaN is missing like NULL."""
    groups = df.groupBy(*same_cells(df)).agg(F.count(F.lit(1)).alias("__n"))
    total = F.coalesce(F.sum("__n"), F.lit(0)).cast("long")
    return groups.agg(*_uniqueness(total, F.count(F.lit(1))))


def row_uniqueness_wide(df: DataFrame) -> DataFrame:
    """The same figures without shuffling whole rows, for wide tables with few duplicates.

    Rows are grouped by a 64-bit hash first. A hash that occurs once is one
    distinct row; only rows with a repeated hash are compared in full, so
    colliding hashes do no harm.
    """
    plain = df.select(*same_cells(df))
    hashed = plain.withColumn("__hash", F.xxhash64(*[F.col(quoted(c)) for c in df.columns]))
    per_hash = cut_lineage(hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")))
    suspects = hashed.join(per_hash.filter("__n > 1").select("__hash"), "__hash", "left_semi")
    # rows with the same hash are told apart under it, so no key holds more than its equal rows
    distinct = suspects.groupBy("__hash", *[F.col(quoted(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    figures = per_hash.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("total"), F.count_if(F.col("__n") == 1).alias("once"))
    # one row joined with one row
    both = figures.crossJoin(F.broadcast(distinct.agg(F.count(F.lit(1)).alias("distinct"))))
    return both.select(*_uniqueness(F.col("total"), F.col("once") + F.col("distinct")))


def same_cells(df: DataFrame) -> list[Column]:
    """The columns with NaN as NULL and one floating zero: rows equal in these are duplicates."""

    def cell(field: T.StructField) -> Column:
        column = F.col(quoted(field.name))
        if isinstance(field.dataType, FLOATING):
            column = F.nanvl(column, F.lit(None).cast(field.dataType)) + F.lit(0.0).cast(field.dataType)
        return column.alias(field.name)

    return [cell(f) for f in df.schema]


def _cell_text(field: T.StructField) -> Column:
    """A cell as text, NULL if it is missing; the two floating zeros are one value."""
    column = F.col(quoted(field.name))
    if isinstance(field.dataType, FLOATING):
        column = null_if_missing(column, field.dataType) + F.lit(0.0).cast(field.dataType)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def value_counts(df: DataFrame) -> DataFrame:
    """(i, value, n): how often each value occurs in the column with index i."""
    # the cells travel with the index of their column, not with its name
    indexes = [str(i) for i in range(len(df.columns))]
    cells = df.select(*[_cell_text(f).alias(i) for i, f in zip(indexes, df.schema)])
    present = cells.unpivot([], indexes, "i", "value").filter("value IS NOT NULL")
    counted = present.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("i").cast("int").alias("i"), "value", "n")


def column_uniqueness(df: DataFrame, approximate: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Distinct values against present values, for every column.

    The exact form groups (column, value) and then (column): two shuffles that
    combine on the map side, however many columns there are; ``counts`` is a
    ``value_counts`` of the table to start from. The approximate form is a
    single aggregation (relative error about 1 %).
    """
    names = [F.lit(c) for c in df.columns]
    if approximate:
        rows = []
        for field in df.schema:
            column = null_if_missing(F.col(quoted(field.name)), field.dataType)
            rows.append(
                F.struct(
                    F.lit(field.name).alias("column"),
                    F.approx_count_distinct(column, 0.01).alias("unique_count"),
                    F.count(column).alias("total_count"),
                )
            )
        counts = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    else:
        found = (
            (value_counts(df) if counts is None else counts)
            .groupBy("i")
            .agg(F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("total_count"))
        )
        # every column gets a row, also one without any value
        every = df.sparkSession.range(len(names)).select(
            F.col("id").cast("int").alias("i"), F.get(F.array(*names), F.col("id").cast("int")).alias("column")
        )
        zero = F.lit(0).cast("long")
        counts = every.join(F.broadcast(found), "i", "left").select(
            "column",
            F.coalesce("unique_count", zero).alias("unique_count"),
            F.coalesce("total_count", zero).alias("total_count"),
        )
    return counts.select(
        "column",
        _percent(F.col("unique_count"), F.col("total_count")).alias("uniqueness"),
        "unique_count",
        "total_count",
    )


def overall_metrics(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row with the four overall percentages and the duplicate rows."""
    facts = column_facts(df) if facts is None else facts
    present = F.col("rows") - F.col("missing")
    cells, filled = F.sum("rows"), F.sum(present)
    scores = facts.withColumn("consistency", F.when(present > 0, _consistency()))
    from_facts = scores.agg(
        _percent(filled, cells).alias("overall_completeness"),
        _percent(filled - F.sum("invalid"), filled).alias("overall_validity"),
        F.round(F.coalesce(F.avg("consistency"), F.lit(0.0)), 2).alias("overall_consistency"),
        F.lit(1).alias("__one"),
    )
    # two one-row frames side by side
    from_rows = row_uniqueness(df).select("overall_uniqueness", "duplicate_rows", F.lit(1).alias("__one"))
    return from_facts.join(F.broadcast(from_rows), "__one").drop("__one")


def quality_score(overall: DataFrame) -> DataFrame:
    """0.3 completeness + 0.2 uniqueness + 0.3 validity + 0.2 consistency."""
    score = (
        F.col("overall_completeness") * 0.3
        + F.col("overall_uniqueness") * 0.2
        + F.col("overall_validity") * 0.3
        + F.col("overall_consistency") * 0.2
    )
    return overall.select(
        "overall_completeness",
        "overall_uniqueness",
        "overall_validity",
        "overall_consistency",
        F.round(score, 2).alias("overall_quality_score"),
    )


def column_scores(facts: DataFrame, uniqueness: DataFrame) -> DataFrame:
    """Long table (category, column, score) of all four dimensions."""
    present = F.col("rows") - F.col("missing")
    scores = {
        "completeness": _percent(present, F.col("rows")),
        "uniqueness": F.col("uniqueness"),
        "validity": _percent(present - F.col("invalid"), present),
        "consistency": F.when(present > 0, _consistency()),
    }
    rows = [
        F.struct(F.lit(n).alias("category"), F.col("column").alias("column"), v.alias("score"))
        for n, v in scores.items()
    ]
    return (
        facts.join(F.broadcast(uniqueness.select("column", "uniqueness")), "column")
        .select(F.inline(F.array(*rows)))
        .filter("score IS NOT NULL")
    )


def problematic_columns(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores under the threshold with their rank, worst first, per category."""
    worst = Window.partitionBy("category").orderBy("score", "column")
    return scores.filter(F.col("score") < threshold).withColumn("rank", F.row_number().over(worst))


def _one_decimal(value: Column) -> Column:
    """One decimal, rounded by the exact binary value; exact ties go to even."""
    whole = F.floor(value)
    rest = value - whole
    digit = F.floor(rest * 10)
    tie = (digit * 10 + 5) / F.lit(100.0)
    up = (rest > tie) | ((rest == tie) & (digit % 2 == 1))
    return F.format_string("%.1f", whole + (digit + up.cast("int")) / F.lit(10.0))


def recommendations(overall: DataFrame, problems: DataFrame) -> DataFrame:
    """Advice per dimension whose overall value is too low.

    The three worst columns of the dimension are named.
    """
    named = (
        problems.filter("rank <= 3")
        .groupBy("category")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "column"))).alias("worst"))
    )
    percent = lambda name: _one_decimal(F.col(name))
    # Limits, severities and wording of the advice.
    completeness = F.concat(
        F.lit("Dataset has "), percent("overall_completeness"),
        F.lit("% completeness. Consider reviewing missing values."),
    )
    uniqueness = F.concat(
        F.lit("Found "), F.col("duplicate_rows").cast("string"),
        F.lit(" duplicate rows. Consider removing duplicates."),
    )
    validity = F.concat(
        F.lit("Dataset has "), percent("overall_validity"), F.lit("% validity. Review invalid values."),
    )
    consistency = F.lit("Some columns show inconsistent formatting. Consider standardizing data formats.")
    advice = [
        ("overall_completeness", 90, "high", "completeness", completeness, True),
        ("overall_uniqueness", 95, "medium", "uniqueness", uniqueness, False),
        ("overall_validity", 95, "high", "validity", validity, True),
        ("overall_consistency", 80, "medium", "consistency", consistency, True),
    ]
    rows = [
        F.when(
            F.col(value) < limit,
            F.struct(
                F.lit(severity).alias("severity"),
                F.lit(category).alias("category"),
                text.alias("text"),
                F.lit(names).alias("names"),
            ),
        )
        for value, limit, severity, category, text, names in advice
    ]
    given = overall.select(F.inline(F.array_compact(F.array(*rows))))
    listed = F.array_join(F.transform("worst", lambda w: w["column"]), ", ")
    suffix = F.when(
        F.col("names") & F.col("worst").isNotNull(),
        F.concat(F.lit(" Most problematic columns: "), listed, F.lit(".")),
    ).otherwise(F.lit(""))
    return given.join(F.broadcast(named), "category", "left").select(
        "severity", "category", F.concat("text", suffix).alias("message")
    )


def column_statistics(
    df: DataFrame, uniqueness: DataFrame | None = None
) -> DataFrame:
    """Per column: type, counts, min/max/mean/median/std or lengths and distinct texts.

    ``uniqueness`` is a ``column_uniqueness`` of the table, if it is at hand.
    """
    none = F.lit(None)
    rows, numeric, text = [], [], []
    for field in df.schema:
        column = F.col(quoted(field.name))
        present = null_if_missing(column, field.dataType)
        number = words = None
        # booleans count as 0 and 1
        if isinstance(field.dataType, NUMERIC + (T.BooleanType,)):
            number = present.cast("double")
            numeric.append(field.name)
        elif isinstance(field.dataType, TEXTUAL):
            words = F.length(column)
            text.append(field.name)
        of_number = lambda f: (none if number is None else f(number)).cast("double")
        of_words = lambda f, kind: (none if words is None else f(words)).cast(kind)
        std = lambda n: F.when(F.count(n) > 0, F.coalesce(F.stddev_samp(n), F.lit(0.0)))
        rows.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(type_class(field.dataType)).alias("data_type"),
                F.count(present).alias("non_null_count"),
                (F.count(F.lit(1)) - F.count(present)).alias("null_count"),
                of_number(F.min).alias("min"),
                of_number(F.max).alias("max"),
                of_number(F.avg).alias("mean"),
                none.cast("double").alias("median"),
                of_number(std).alias("std"),
                of_words(F.min, "long").alias("min_length"),
                of_words(F.max, "long").alias("max_length"),
                of_words(F.avg, "double").alias("avg_length"),
            )
        )
    stats = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    if numeric:
        medians = exact_medians(df, numeric).withColumnRenamed("median", "__median")
        stats = stats.join(F.broadcast(medians), "column", "left").withColumn("median", F.col("__median")).drop("__median")
    if not text:
        return stats.withColumn("unique_values", none.cast("long"))
    if uniqueness is None:
        uniqueness = column_uniqueness(df.select(*[F.col(quoted(c)) for c in text]))
    counts = uniqueness.filter(F.col("column").isin(text)).select(
        "column", F.col("unique_count").alias("unique_values")
    )
    return stats.join(F.broadcast(counts), "column", "left").withColumn(
        "unique_values", F.when(F.col("non_null_count") > 0, F.col("unique_values"))
    )


def data_type_distribution(df: DataFrame) -> DataFrame:
    """Columns per type class; reads the schema only."""
    counts: dict[str, int] = {}
    for field in df.schema:
        kind = type_class(field.dataType)
        counts[kind] = counts.get(kind, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "data_type string, columns bigint")


def dataset_info(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )
