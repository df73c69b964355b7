"""Metrics and profiles over dirty_orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import profile as P
from tidemark.plans.quality import QualityReport

from .fixtures import view, with_views

COLUMNS = {
    "o_orderkey": "integer",
    "o_custkey": "integer",
    "o_orderstatus": "text",
    "o_totalprice": "float",
    "o_orderdate": "datetime",
    "ship_date": "datetime",
    "order_date_text": "text",
    "email": "text",
    "empty_col": "text",
}
SPARK_TYPES = {"integer": "long", "text": "string", "float": "double", "datetime": "timestamp"}


def _per_column(select) -> str:
    return "\nUNION ALL\n".join(select(c, t) for c, t in COLUMNS.items())


def _facts(name, kind):
    invalid = {"float": f"count(*) FILTER (WHERE isinf({name}))", "text": f"count(*) FILTER (WHERE trim({name}) = '')"}
    text = kind == "text"
    return (
        f"SELECT '{name}' AS \"column\", '{kind}' AS data_type, count(*) AS rows, count(*) - count({name}) AS missing, "
        f"{invalid.get(kind, '0')} AS invalid, "
        + (f"stddev_samp(length({name})) AS length_std, avg(length({name})) AS length_mean" if text
           else "CAST(NULL AS DOUBLE) AS length_std, CAST(NULL AS DOUBLE) AS length_mean")
        + " FROM dirty_orders"
    )


def _unique(name, kind):
    return (
        f"SELECT '{name}' AS \"column\", coalesce(round(100.0 * count(DISTINCT {name}) / nullif(count({name}), 0), 2), 0.0)::DOUBLE AS uniqueness, "
        f"count(DISTINCT {name}) AS unique_count, count({name}) AS total_count FROM dirty_orders"
    )


FACTS = f"""facts AS ({_per_column(_facts)}),
uniq AS ({_per_column(_unique)}),
completeness AS (SELECT "column", round(100.0 * (rows - missing) / rows, 2)::DOUBLE AS completeness, missing AS missing_count, rows AS total_count FROM facts),
validity AS (SELECT "column", coalesce(round(100.0 * (rows - missing - invalid) / nullif(rows - missing, 0), 2), 0.0)::DOUBLE AS validity,
  rows - missing - invalid AS valid_count, CAST(invalid AS BIGINT) AS invalid_count, rows - missing AS total_count FROM facts),
consistency AS (SELECT "column", CASE WHEN data_type = 'text'
  THEN round(greatest(0.0, least(100.0, 100 - 10 * coalesce(coalesce(length_std, 0.0) / nullif(length_mean, 0), 0.0))), 2) ELSE 100.0 END::DOUBLE AS consistency, data_type
  FROM facts WHERE rows > missing),
uniq_rows AS (SELECT round(100.0 * (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders) d) / count(*), 2)::DOUBLE AS overall_uniqueness,
  count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders) d) AS unique_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders) d) AS duplicate_rows FROM dirty_orders),
overall AS (SELECT
  (SELECT round(100.0 * sum(rows - missing) / sum(rows), 2)::DOUBLE FROM facts) AS overall_completeness,
  (SELECT overall_uniqueness FROM uniq_rows) AS overall_uniqueness,
  (SELECT round(100.0 * sum(rows - missing - invalid) / sum(rows - missing), 2)::DOUBLE FROM facts) AS overall_validity,
  (SELECT round(avg(consistency), 2) FROM consistency) AS overall_consistency),
scores AS (SELECT 'completeness' AS category, "column", completeness AS score FROM completeness
  UNION ALL SELECT 'uniqueness', "column", uniqueness FROM uniq
  UNION ALL SELECT 'validity', "column", validity FROM validity
  UNION ALL SELECT 'consistency', "column", consistency FROM consistency),
problems AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY score, "column") AS INT) AS rank FROM scores WHERE score < 80)"""


def _sql(body: str) -> str:
    return with_views(f"WITH {FACTS}\n{body}", "dirty_orders")


def _dirty(spark, sf_dir):
    return view(spark, sf_dir, "dirty_orders")


def _on_facts(operator):
    return lambda spark, sf_dir: operator(M.column_facts(_dirty(spark, sf_dir)))


def _rounded(df, *names, digits=4):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


def statistics_numeric(spark, sf_dir):
    stats = M.column_statistics(_dirty(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice"))
    return _rounded(
        stats.select("column", "non_null_count", "null_count", "min", "max", "mean", "median", "std"),
        "min", "max", "mean", "median", "std", digits=2,
    )


LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_statistics(spark, sf_dir):
    """All numeric columns of the largest table."""
    lineitem = view(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS)
    stats = M.column_statistics(lineitem)
    return _rounded(stats.select("column", "min", "max", "mean", "median"), "min", "max", "mean", "median")


def statistics_text(spark, sf_dir):
    stats = M.column_statistics(_dirty(spark, sf_dir).select("o_orderstatus", "order_date_text", "email", "empty_col"))
    return _rounded(
        stats.select("column", "non_null_count", "null_count", "min_length", "max_length", "avg_length", "unique_values"),
        "avg_length",
    )


def profile_columns(spark, sf_dir):
    return _rounded(
        P.profile_columns(_dirty(spark, sf_dir)),
        "null_ratio", "unique_ratio", "min", "max", "mean", "median", "std", "avg_length", digits=2,
    )


EDITS = {
    "columns": {
        "email": {"required": True, "regex_pattern": "@example"},
        "o_totalprice": {"range": {"min": 0}},
        "o_orderkey": {"skip_range": True, "type": "string", "nullable": True},
        "o_orderstatus": {"allowed_values": ["O", "F", "P"], "unique": True},
        "order_date_text": {"format": "YYYY-MM-DD"},
    },
    "cross_validations": [{"column1": "ship_date", "operator": ">=", "column2": "o_orderdate"}],
}


def suggest_rules(spark, sf_dir):
    return P.suggest_rules(P.profile_columns(_dirty(spark, sf_dir)), EDITS)


def suggest_schema(spark, sf_dir):
    schema = P.suggest_schema(P.profile_columns(_dirty(spark, sf_dir)), EDITS)
    return schema.select("name", "type", "nullable")


SAMPLE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
PROFILE_NUMBERS = ["null_ratio", "unique_ratio", "min", "max", "mean", "median", "std", "avg_length"]
LINEITEM = {
    **dict.fromkeys(["l_orderkey", "l_partkey", "l_suppkey"], ("integer", "long")), "l_linenumber": ("integer", "integer"),
    **dict.fromkeys(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ("decimal", "double")),
    **dict.fromkeys(["l_returnflag", "l_linestatus"], ("text", "string")), "l_shipdate": ("datetime", "timestamp"),
}
CUSTOMER = {
    "c_custkey": ("integer", "long"), "c_name": ("text", "string"), "c_nationkey": ("integer", "integer"), "c_acctbal": ("decimal", "double"),
    "c_mktsegment": ("text", "string"),
}


def profile_sampled(spark, sf_dir):
    sample = P.sample_rows(view(spark, sf_dir, "lineitem"), 10_000, SAMPLE_KEY)
    return _rounded(P.profile_columns(sample), *PROFILE_NUMBERS, digits=2)


def inspect_dataset(spark, sf_dir):
    return _rounded(P.inspect_dataset(view(spark, sf_dir, "customer"), "parquet"), *PROFILE_NUMBERS, digits=2)


def data_type_distribution(spark, sf_dir):
    return M.data_type_distribution(view(spark, sf_dir, "lineitem"))


def _report(name):
    return lambda spark, sf_dir: getattr(QualityReport(_dirty(spark, sf_dir)), name)


QUERIES = {
    "completeness_columns": _on_facts(M.completeness_columns),
    "completeness_overall": _on_facts(M.completeness_overall),
    "row_uniqueness": lambda spark, sf_dir: M.row_uniqueness(view(spark, sf_dir, "dup_customer")),
    "row_uniqueness_wide": lambda spark, sf_dir: M.row_uniqueness_wide(view(spark, sf_dir, "dup_customer")),
    "column_uniqueness": lambda spark, sf_dir: M.column_uniqueness(_dirty(spark, sf_dir)),
    "validity_columns": _on_facts(M.validity_columns),
    "validity_overall": _on_facts(M.validity_overall),
    "consistency_columns": _on_facts(M.consistency_columns),
    "consistency_overall": _on_facts(M.consistency_overall),
    "quality_score": lambda spark, sf_dir: M.quality_score(M.overall_metrics(_dirty(spark, sf_dir))),
    "problematic_columns": _report("problems"),
    "recommendations": _report("recommendations"),
    "column_statistics_numeric": statistics_numeric,
    "column_statistics_median": lineitem_statistics,
    "column_statistics_text": statistics_text,
    "dataset_info": lambda spark, sf_dir: M.dataset_info(_dirty(spark, sf_dir)),
    "null_counts": lambda spark, sf_dir: P.null_counts(_dirty(spark, sf_dir)),
    "profile_columns": profile_columns,
    "top_values": lambda spark, sf_dir: P.top_values(view(spark, sf_dir, "orders").join(
        view(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderstatus", "o_orderpriority", "c_mktsegment", "c_name")),
    "suggest_rules": suggest_rules,
    "suggest_schema": suggest_schema,
    "profile_sampled": profile_sampled,
    "inspect_dataset": inspect_dataset,
    "data_type_distribution": data_type_distribution,
}


ROW_UNIQUENESS = with_views(
    """
    SELECT round(100.0 * u / t, 2)::DOUBLE AS overall_uniqueness, t AS total_rows, u AS unique_rows, t - u AS duplicate_rows
    FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_customer) d) AS u, (SELECT count(*) FROM dup_customer) AS t) AS x""",
    "dup_customer",
)


def _numeric_sql(columns, digits, table, extra=""):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {extra.format(c=c)} round(min({c})::DOUBLE, {digits}) AS min, round(max({c})::DOUBLE, {digits}) AS max, "
        f"round(avg({c}), {digits}) AS mean, round(median({c})::DOUBLE, {digits}) AS median"
        + (f", round(stddev_samp({c}), {digits}) AS std" if extra else "")
        + f" FROM {table}"
        for c in columns
    )


def _profile_sql(c, kind, table="dirty_orders", name=None):
    number, text = kind in ("integer", "float", "decimal"), kind == "text"
    std = "CAST('NaN' AS DOUBLE)" if kind == "float" else f"round(stddev_samp({c}), 2)"
    return (
        f"SELECT '{c}' AS \"column\", '{name or SPARK_TYPES[kind]}' AS type, count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c}))::DOUBLE / count(*), 2) AS null_ratio, count(DISTINCT {c}) AS unique_count, "
        f"round(count(DISTINCT {c})::DOUBLE / count(*), 2) AS unique_ratio, "
        + (f"round(min({c})::DOUBLE, 2) AS min, round(max({c})::DOUBLE, 2) AS max, round(avg({c}), 2) AS mean, "
           f"round(median({c})::DOUBLE, 2) AS median, {std} AS std, " if number
           else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, ")
        + (f"round(avg(length({c})), 2) AS avg_length, max(length({c})) AS max_length" if text
           else "NULL::DOUBLE AS avg_length, NULL::BIGINT AS max_length")
        + f" FROM {table}"
    )


def _rule_rows(c, kind):
    null_ratio = f"(count(*) - count({c}))::DOUBLE / count(*)"
    unique_ratio = f"count(DISTINCT {c})::DOUBLE / count(*)"
    edit = EDITS["columns"].get(c, {})
    row = "SELECT '{k}' AS type, '{c}' AS \"column\", {lo} AS min, {hi} AS max, {a} AS argument, NULL::VARCHAR AS other_column, {p} AS primary_key FROM dirty_orders{h}"
    none = {"c": c, "lo": "NULL::DOUBLE", "hi": "NULL::DOUBLE", "a": "NULL::VARCHAR", "p": "false"}
    rows = [
        row.format(**{**none, "k": "not_null", "h": "" if edit.get("required") else f" HAVING {null_ratio} < 0.05"})
        if not edit.get("required") else row.format(**{**none, "k": "not_null", "h": " HAVING count(*) >= 0"}),
        row.format(**{**none, "k": "uniqueness", "p": "true", "h": " HAVING count(*) >= 0" if edit.get("unique") else f" HAVING {unique_ratio} > 0.95"}),
    ]
    if kind in ("integer", "float") and not edit.get("skip_range"):
        low = "0.0::DOUBLE" if "min" in edit.get("range", {}) else f"min({c})::DOUBLE"
        rows.append(row.format(**{**none, "k": "range", "lo": low, "hi": f"max({c})::DOUBLE", "h": ""}))
    for option, k in (("format", "format"), ("regex_pattern", "regex")):
        if edit.get(option):
            rows.append(row.format(**{**none, "k": k, "a": f"'{edit[option]}'", "h": " HAVING count(*) >= 0"}))
    if edit.get("allowed_values"):
        values = "[" + ",".join(f'"{v}"' for v in edit["allowed_values"]) + "]"
        rows.append(row.format(**{**none, "k": "in_set", "a": f"'{values}'", "h": " HAVING count(*) >= 0"}))
    return "\nUNION ALL\n".join(rows)


ORACLE = {
    "completeness_columns": _sql("SELECT * FROM completeness"),
    "completeness_overall": _sql(
        "SELECT round(100.0 * sum(rows - missing) / sum(rows), 2)::DOUBLE AS overall_completeness, sum(rows)::BIGINT AS total_cells, "
        "sum(missing)::BIGINT AS missing_cells, sum(rows - missing)::BIGINT AS filled_cells FROM facts"
    ),
    "row_uniqueness": ROW_UNIQUENESS,
    "row_uniqueness_wide": ROW_UNIQUENESS,
    "column_uniqueness": _sql("SELECT * FROM uniq"),
    "validity_columns": _sql("SELECT * FROM validity"),
    "validity_overall": _sql(
        "SELECT round(100.0 * sum(rows - missing - invalid) / sum(rows - missing), 2)::DOUBLE AS overall_validity, sum(rows - missing)::BIGINT AS total_cells, "
        "sum(rows - missing - invalid)::BIGINT AS valid_cells, sum(invalid)::BIGINT AS invalid_cells FROM facts"
    ),
    "consistency_columns": _sql("SELECT * FROM consistency"),
    "consistency_overall": _sql("SELECT overall_consistency FROM overall"),
    "quality_score": _sql(
        "SELECT *, round(overall_completeness * 0.3 + overall_uniqueness * 0.2 + overall_validity * 0.3 + overall_consistency * 0.2, 2)::DOUBLE AS overall_quality_score FROM overall"
    ),
    "problematic_columns": _sql("SELECT category, \"column\", score, rank FROM problems"),
    "recommendations": _sql(
        """
        SELECT severity, category, message FROM (
          SELECT 'high' AS severity, 'completeness' AS category, format('Dataset has {:.1f}% completeness. Consider reviewing missing values.', overall_completeness)
            || coalesce(' Most problematic columns: ' || (SELECT string_agg("column", ', ' ORDER BY rank) FROM problems WHERE category = 'completeness' AND rank <= 3) || '.', '') AS message,
            overall_completeness < 90 AS given FROM overall
          UNION ALL SELECT 'medium', 'uniqueness', format('Found {} duplicate rows. Consider removing duplicates.', (SELECT duplicate_rows FROM uniq_rows)), overall_uniqueness < 95 FROM overall
          UNION ALL SELECT 'high', 'validity', format('Dataset has {:.1f}% validity. Review invalid values.', overall_validity)
            || coalesce(' Most problematic columns: ' || (SELECT string_agg("column", ', ' ORDER BY rank) FROM problems WHERE category = 'validity' AND rank <= 3) || '.', ''),
            overall_validity < 95 FROM overall
          UNION ALL SELECT 'medium', 'consistency', 'Some columns show inconsistent formatting. Consider standardizing data formats.'
            || coalesce(' Most problematic columns: ' || (SELECT string_agg("column", ', ' ORDER BY rank) FROM problems WHERE category = 'consistency' AND rank <= 3) || '.', ''),
            overall_consistency < 80 FROM overall
        ) AS r WHERE given"""
    ),
    "column_statistics_median": _numeric_sql(LINEITEM_NUMBERS, 4, "lineitem"),
    "column_statistics_numeric": with_views(
        _numeric_sql(["o_orderkey", "o_custkey"], 2, "dirty_orders", "count({c}) AS non_null_count, count(*) - count({c}) AS null_count,")
        + "\nUNION ALL\nSELECT 'o_totalprice', count(o_totalprice), count(*) - count(o_totalprice), round(min(o_totalprice), 2), max(o_totalprice), "
        "avg(o_totalprice), round(median(o_totalprice), 2), CAST('NaN' AS DOUBLE) FROM dirty_orders",
        "dirty_orders",
    ),
    "column_statistics_text": with_views(
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS non_null_count, count(*) - count({c}) AS null_count, min(length({c})) AS min_length, "
            f"max(length({c})) AS max_length, round(avg(length({c})), 4) AS avg_length, "
            f"CASE WHEN count({c}) > 0 THEN count(DISTINCT {c}) END AS unique_values FROM dirty_orders"
            for c in ("o_orderstatus", "order_date_text", "email", "empty_col")
        ),
        "dirty_orders",
    ),
    "dataset_info": with_views(
        f"SELECT count(*) AS rows, {len(COLUMNS)}::BIGINT AS columns, '{','.join(COLUMNS)}' AS column_names FROM dirty_orders", "dirty_orders"
    ),
    "null_counts": with_views(
        _per_column(lambda c, t: f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count FROM dirty_orders"), "dirty_orders"
    ),
    "profile_columns": with_views(_per_column(_profile_sql), "dirty_orders"),
    "profile_sampled": f"""
        WITH sample AS (SELECT * FROM lineitem ORDER BY md5(concat_ws('|', '42', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in SAMPLE_KEY)})), {', '.join(SAMPLE_KEY)} LIMIT 10000)
        """ + "\nUNION ALL\n".join(_profile_sql(c, kind, "sample", name) for c, (kind, name) in LINEITEM.items()),
    "inspect_dataset": """
        SELECT p.*, sample_values, 'parquet' AS format, '' AS detected_options, (SELECT count(*) FROM customer) AS row_count, 5::BIGINT AS column_count FROM ("""
    + "\nUNION ALL\n".join(_profile_sql(c, kind, "customer", name) for c, (kind, name) in CUSTOMER.items())
    + ") AS p LEFT JOIN ("
    + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS name, list(v ORDER BY n DESC, v) AS sample_values FROM (
          SELECT {c} AS v, count(*) AS n FROM customer GROUP BY {c} ORDER BY n DESC, v LIMIT 5) AS t"""
        for c, (kind, _) in CUSTOMER.items() if kind == "text"
    )
    + ') AS s ON p."column" = s.name',
    "data_type_distribution": """
        SELECT CASE WHEN t IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN t = 'DOUBLE' THEN 'float' WHEN t = 'VARCHAR' THEN 'text' ELSE 'datetime' END AS data_type,
          count(*) AS columns FROM (SELECT unnest(["""
    + ", ".join(f"typeof({c})" for c in LINEITEM)
    + """]) AS t FROM (SELECT * FROM lineitem LIMIT 1) AS one) AS types GROUP BY 1""",
    "top_values": "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", v AS value, n AS count, CAST(r AS INT) AS rank FROM (
          SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY {c}) AS t WHERE r <= 5"""
        for c in ("o_orderstatus", "o_orderpriority", "c_mktsegment", "c_name")
    ),
    "suggest_schema": with_views(
        _per_column(lambda c, t: f"SELECT '{c}' AS name, '{'string' if c == 'o_orderkey' else SPARK_TYPES[t]}' AS type, "
                                 + ("true" if c == "o_orderkey" else f"count(*) > count({c})") + " AS nullable FROM dirty_orders"
                                 + (" HAVING count(*) >= 0" if c == "o_orderkey" else "")),
        "dirty_orders",
    ),
    "suggest_rules": with_views(
        _per_column(_rule_rows)
        + "\nUNION ALL SELECT 'cross_column_comparison', 'ship_date', NULL, NULL, '>=', 'o_orderdate', false",
        "dirty_orders",
    ),
}
