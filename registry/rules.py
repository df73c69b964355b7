"""Rule validation over dirty_orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import rules as R

from .fixtures import run_sql, view, with_views

RULES = [
    {"type": "not_null", "column": "o_custkey"},
    {"type": "not_null", "column": "o_totalprice"},
    {"type": "uniqueness", "columns": ["o_orderkey"]},
    {"type": "uniqueness", "columns": ["o_custkey", "order_date_text"]},
    {"type": "format", "column": "order_date_text", "format": "YYYY-MM-DD"},
    {"type": "format", "column": "email", "format": "^user[0-9]+@"},
    {"type": "range", "column": "o_totalprice", "min": 0, "max": 400000},
    {"type": "in_set", "column": "o_orderstatus", "values": ["O", "F", "P"]},
    {"type": "regex", "column": "email", "pattern": r"@example\.com$"},
    {"type": "value_distribution", "column": "o_orderstatus", "value": "O", "min_freq": 0.2, "max_freq": 0.4},
    {"type": "value_distribution", "column": "o_orderstatus", "value": "X", "min_freq": 0.5, "max_freq": 0.9},
    {"type": "cross_column_comparison", "column1": "ship_date", "operator": ">=", "column2": "o_orderdate"},
    {"type": "not_null", "column": "no_such_column"},
    {"type": "preset", "column": "email", "preset": "email"},
    {"type": "conditional", "when": "o_orderstatus = 'F'", "then": [
        {"type": "not_null", "column": "o_totalprice"}, {"type": "range", "column": "o_totalprice", "min": 0}]},
    {"type": "foreign_key", "column": "o_custkey", "reference": "customer", "reference_column": "c_custkey"},
]

ROW_RULES = [r for r in RULES if r["type"] in R.ROW_RULES and r["column" if "column" in r else "type"] != "no_such_column"]
# all rules that can label a row
LABEL_RULES = [r for r in RULES if r in ROW_RULES or r["type"] in R.SET_RULES]

# violation conditions in SQL, by the name the rule gets
CONDITIONS = {
    "null_o_custkey": "o_custkey IS NULL",
    "null_o_totalprice": "o_totalprice IS NULL",
    "date_format_order_date_text": "order_date_text IS NOT NULL AND try_strptime(order_date_text, '%Y-%m-%d') IS NULL",
    "format_email": "NOT regexp_matches(email, '^user[0-9]+@')",
    "range_o_totalprice": "o_totalprice < 0 OR o_totalprice > 400000",
    "in_set_o_orderstatus": "o_orderstatus NOT IN ('O', 'F', 'P')",
    "regex_email": "NOT regexp_matches(email, '@example\\.com$')",
    "cross_column_ship_date_>=_o_orderdate": "NOT (ship_date >= o_orderdate)",
    "email_email": "NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')",
    "conditional_o_totalprice_o_totalprice": "o_orderstatus = 'F' AND (o_totalprice IS NULL OR o_totalprice < 0)",
}

# rules about the whole set, over dirty_orders with its groups counted
SET_CONDITIONS = {
    "uniqueness_o_orderkey": "n_key > 1",
    "uniqueness_o_custkey_order_date_text": "n_pair > 1",
    "foreign_key_o_custkey": "o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)",
}
COUNTED = """(SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n_key,
  count(*) OVER (PARTITION BY o_custkey, order_date_text) AS n_pair FROM dirty_orders) AS counted"""
FLAGGED = "(SELECT *, " + ", ".join(f"coalesce({c}, false) AS \"{n}\"" for n, c in SET_CONDITIONS.items()) + f" FROM {COUNTED}) AS flagged"
# the labels in the order of LABEL_RULES
LABELS = {**CONDITIONS, **{n: f'"{n}"' for n in SET_CONDITIONS}}
ALL_SQL = (
    "list_filter(["
    + ", ".join(f"CASE WHEN {LABELS[R.rule_name(r)]} THEN '{R.rule_name(r)}' END" for r in LABEL_RULES)
    + "], lambda x: x IS NOT NULL)"
)

BROKEN_SQL = (
    "list_filter(["
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CONDITIONS.items())
    + "], lambda x: x IS NOT NULL)"
)


def _failing(rule, *columns):
    def query(spark, sf_dir):
        return R.failing_rows(view(spark, sf_dir, "dirty_orders"), rule).select(*columns)

    return query


def _failing_sql(condition, *columns):
    return with_views(f"SELECT {', '.join(columns)} FROM dirty_orders WHERE {condition}", "dirty_orders")


def rules_summary(spark, sf_dir):
    return R.rules_summary(
        view(spark, sf_dir, "dirty_orders"), RULES, {"customer": view(spark, sf_dir, "customer")}
    )


def _summary_sql() -> str:
    types = {R.rule_name(r): (r["type"], ",".join(R.rule_columns(r))) for r in RULES}

    def row(name, failed, duplicates="NULL", frequency="NULL", status=None):
        kind, column = types[name]
        status = status or f"CASE WHEN {failed} > 0 THEN 'FAILED' ELSE 'PASSED' END"
        return (
            f"SELECT '{name}' AS rule, '{kind}' AS type, '{column}' AS \"column\", "
            f"CAST({failed} AS BIGINT) AS failed_count, CAST({duplicates} AS BIGINT) AS duplicate_rows, "
            f"CAST({frequency} AS DOUBLE) AS frequency, {status} AS status"
        )

    parts = [row(n, f"count(*) FILTER (WHERE {c})") + " FROM dirty_orders" for n, c in CONDITIONS.items()]
    for cols in (["o_orderkey"], ["o_custkey", "order_date_text"]):
        parts.append(
            row("uniqueness_" + "_".join(cols), "count(*)", "coalesce(sum(n), 0)")
            + f" FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY {', '.join(cols)} HAVING count(*) > 1) AS g"
        )
    for value, low, high in (("O", 0.2, 0.4), ("X", 0.5, 0.9)):
        share = f"(count(*) FILTER (WHERE o_orderstatus = '{value}'))::DOUBLE / count(*)"
        inside = f"{share} BETWEEN {low} AND {high}"
        parts.append(
            row(
                f"distribution_o_orderstatus_{value}",
                f"(CASE WHEN {inside} THEN 0 ELSE 1 END)",
                frequency=share,
                status=f"CASE WHEN {inside} THEN 'PASSED' ELSE 'FAILED' END",
            )
            + " FROM dirty_orders"
        )
    parts.append(row("null_no_such_column", "NULL", status="'SKIPPED'"))
    parts.append(
        row("foreign_key_o_custkey", "count(*)")
        + " FROM dirty_orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)"
    )
    return with_views("\nUNION ALL\n".join(parts), "dirty_orders")


def rule_uniqueness(spark, sf_dir):
    return R.duplicate_groups(view(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def rule_value_distribution(spark, sf_dir):
    rules = [r for r in RULES if r["type"] == "value_distribution"]
    return R.rules_summary(view(spark, sf_dir, "dirty_orders"), rules).select(
        "rule", F.round("frequency", 6).alias("frequency"), "status"
    )


def rule_failure_samples(spark, sf_dir):
    df, references = view(spark, sf_dir, "dirty_orders"), {"customer": view(spark, sf_dir, "customer")}
    return R.rule_failure_samples(df, LABEL_RULES, ["o_orderkey"], references=references).select(
        "rule", "sample_no", "o_orderkey", "email"
    )


def rule_foreign_key(spark, sf_dir):
    return R.broken_references(
        view(spark, sf_dir, "dirty_orders"), "o_custkey", view(spark, sf_dir, "customer"), "c_custkey"
    )


def rule_presets(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_orders").withColumn(
        "phone", F.concat(F.lit("555-"), F.lpad(F.pmod("o_orderkey", F.lit(1000)).cast("string"), 3, "0"),
                          F.when(F.col("o_orderkey") % 19 == 0, F.lit("-12")).otherwise(F.lit("-1234"))))
    rules = [{"type": "preset", "column": "email", "preset": "email"},
             {"type": "preset", "column": "phone", "preset": "phone"}]
    return R.rules_summary(df, rules).select("rule", "failed_count", "status")


def rule_custom(spark, sf_dir):
    # a local function travels with the task
    def check_digit(values):
        """The last digit is the sum of the others modulo ten, on whole batches."""
        last, rest, total = values % 10, values // 10, 0
        while (rest > 0).any():
            total, rest = total + rest % 10, rest // 10
        return total % 10 == last

    rule = {"type": "custom", "column": "o_custkey", "name": "check_digit", "predicate": check_digit}
    return R.failing_rows(view(spark, sf_dir, "dirty_orders"), rule).select("o_orderkey", "o_custkey")


def rule_conditional(spark, sf_dir):
    rule = next(r for r in RULES if r["type"] == "conditional")
    return R.failing_rows(view(spark, sf_dir, "dirty_orders"), rule).select("o_orderkey", "o_totalprice")


def valid_subset(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_orders").select(
        "o_custkey", "order_date_text", "o_orderkey", "o_orderstatus", "o_totalprice", "email", "ship_date", "o_orderdate"
    )
    rules = [r for r in LABEL_RULES if r.get("columns") != ["o_custkey", "order_date_text"]]
    references = {"customer": view(spark, sf_dir, "customer")}
    return R.valid_subset(df, rules, ["o_custkey", "order_date_text"], references).select(
        "o_custkey", "order_date_text", "o_orderkey"
    )


def quarantine_split(spark, sf_dir):
    references = {"customer": view(spark, sf_dir, "customer")}
    return R.rows_by_reason(view(spark, sf_dir, "dirty_orders"), LABEL_RULES, references).select("verdict", "reason", "o_orderkey")


def null_or_blank(spark, sf_dir):
    return R.null_or_blank(view(spark, sf_dir, "dirty_orders"))


def duplicate_groups(spark, sf_dir):
    return R.duplicate_groups(view(spark, sf_dir, "dup_customer")).orderBy(F.desc("count"), "c_custkey")


def duplicate_rate(spark, sf_dir):
    return R.duplicate_rate(view(spark, sf_dir, "dup_customer"))


def timeliness(spark, sf_dir):
    return R.timeliness(view(spark, sf_dir, "events"), "ts", "2024-01-31 00:00:00", 7)


PROBLEM_RULES = [
    {"type": "not_null", "column": "o_totalprice"},
    {"type": "range", "column": "o_totalprice", "min": 0, "max": 450000},
    {"type": "format", "column": "order_date_text", "format": "YYYY-MM-DD"},
    {"type": "cross_column_comparison", "column1": "ship_date", "operator": ">", "column2": "o_orderdate"},
    {"type": "uniqueness", "columns": ["o_custkey", "order_date_text"]},
    {"type": "foreign_key", "column": "o_custkey", "reference": "customer", "reference_column": "c_custkey"},
    {"type": "schema", "column": "order_date_text", "dtype": "date"},
]

# the defects dirty_orders was given, as labels
EXPECTED_SQL = """
SELECT o_orderkey, 'NULL_VALUE' AS problem_type FROM orders WHERE o_orderkey % 43 = 0
UNION ALL SELECT o_orderkey, 'OUT_OF_RANGE' FROM orders WHERE o_orderkey % 37 = 0 OR o_orderkey % 67 = 0
UNION ALL SELECT o_orderkey, 'INVALID_FORMAT' FROM orders WHERE o_orderkey % 31 = 0
UNION ALL SELECT o_orderkey, 'INCONSISTENT' FROM orders WHERE o_orderkey % 47 = 0
UNION ALL SELECT o_orderkey, 'MISSING_FK' FROM orders WHERE o_orderkey % 59 = 0 AND o_orderkey % 29 <> 0
UNION ALL SELECT o_orderkey, 'WRONG_TYPE' FROM orders WHERE o_orderkey % 31 = 0
UNION ALL SELECT o_orderkey, 'DUPLICATE' FROM (
  SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS n FROM orders) AS x WHERE n > 1
"""


def detection_precision_recall(spark, sf_dir):
    references = {"customer": view(spark, sf_dir, "customer")}
    found = R.detected_problems(view(spark, sf_dir, "dirty_orders"), PROBLEM_RULES, "o_orderkey", references)
    return R.detection_quality(run_sql(spark, sf_dir, EXPECTED_SQL), found, "o_orderkey")


QUERIES = {
    "rules_summary": rules_summary,
    "rule_not_null": _failing(RULES[0], "o_orderkey"),
    "rule_uniqueness": rule_uniqueness,
    "rule_date_format": _failing(RULES[4], "o_orderkey", "order_date_text"),
    "rule_format_regex": _failing(RULES[5], "o_orderkey", "email"),
    "rule_range": _failing(RULES[6], "o_orderkey", "o_totalprice"),
    "rule_in_set": _failing(RULES[7], "o_orderkey", "o_orderstatus"),
    "rule_regex": _failing(RULES[8], "o_orderkey", "email"),
    "rule_value_distribution": rule_value_distribution,
    "rule_cross_column": _failing(RULES[11], "o_orderkey"),
    "rule_failure_samples": rule_failure_samples,
    "rule_foreign_key": rule_foreign_key,
    "rule_presets": rule_presets,
    "rule_conditional": rule_conditional,
    "rule_custom": rule_custom,
    "valid_subset": valid_subset,
    "quarantine_split": quarantine_split,
    "null_or_blank": null_or_blank,
    "duplicate_groups": duplicate_groups,
    "duplicate_rate": duplicate_rate,
    "timeliness": timeliness,
    "detection_precision_recall": detection_precision_recall,
}

ORACLE = {
    "rules_summary": _summary_sql(),
    "rule_not_null": _failing_sql(CONDITIONS["null_o_custkey"], "o_orderkey"),
    "rule_uniqueness": "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "rule_date_format": _failing_sql(CONDITIONS["date_format_order_date_text"], "o_orderkey", "order_date_text"),
    "rule_format_regex": _failing_sql(CONDITIONS["format_email"], "o_orderkey", "email"),
    "rule_range": _failing_sql(CONDITIONS["range_o_totalprice"], "o_orderkey", "o_totalprice"),
    "rule_in_set": _failing_sql(CONDITIONS["in_set_o_orderstatus"], "o_orderkey", "o_orderstatus"),
    "rule_regex": _failing_sql(CONDITIONS["regex_email"], "o_orderkey", "email"),
    "rule_value_distribution": with_views(
        """
        SELECT rule, round(f, 6) AS frequency, CASE WHEN f BETWEEN lo AND hi THEN 'PASSED' ELSE 'FAILED' END AS status
        FROM (
          SELECT 'distribution_o_orderstatus_O' AS rule, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) AS f, 0.2 AS lo, 0.4 AS hi FROM dirty_orders
          UNION ALL
          SELECT 'distribution_o_orderstatus_X', avg(CASE WHEN o_orderstatus = 'X' THEN 1.0 ELSE 0.0 END), 0.5, 0.9 FROM dirty_orders
        ) AS t""",
        "dirty_orders",
    ),
    "rule_cross_column": _failing_sql(CONDITIONS["cross_column_ship_date_>=_o_orderdate"], "o_orderkey"),
    "rule_failure_samples": with_views(
        f"""
        SELECT rule, CAST(sample_no AS INT) AS sample_no, o_orderkey, email FROM (
          SELECT rule, o_orderkey, email, row_number() OVER (PARTITION BY rule ORDER BY o_orderkey) AS sample_no
          FROM (SELECT unnest({ALL_SQL}) AS rule, o_orderkey, email FROM {FLAGGED}) AS e
        ) AS r WHERE sample_no <= 5""",
        "dirty_orders",
    ),
    "rule_foreign_key": with_views(
        """
        SELECT o_custkey AS value, count(*) AS rows FROM dirty_orders
        WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""",
        "dirty_orders",
    ),
    "rule_presets": with_views(
        """
        SELECT 'email_email' AS rule, count(*) FILTER (WHERE email = 'bad-email') AS failed_count,
          CASE WHEN count(*) FILTER (WHERE email = 'bad-email') > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM dirty_orders
        UNION ALL
        SELECT 'phone_phone', count(*) FILTER (WHERE o_orderkey % 19 = 0),
          CASE WHEN count(*) FILTER (WHERE o_orderkey % 19 = 0) > 0 THEN 'FAILED' ELSE 'PASSED' END FROM dirty_orders""",
        "dirty_orders",
    ),
    "rule_conditional": _failing_sql(
        CONDITIONS["conditional_o_totalprice_o_totalprice"], "o_orderkey", "o_totalprice"
    ),
    "rule_custom": with_views(
        """
        SELECT o_orderkey, o_custkey FROM dirty_orders
        WHERE o_custkey IS NOT NULL
          AND coalesce(list_sum([CAST(d AS INT) FOR d IN string_split(CAST(o_custkey // 10 AS VARCHAR), '')]), 0) % 10 <> o_custkey % 10""",
        "dirty_orders",
    ),
    "valid_subset": with_views(
        f"""
        SELECT o_custkey, order_date_text, min(o_orderkey) AS o_orderkey FROM {FLAGGED}
        WHERE len({BROKEN_SQL}) = 0 AND NOT "uniqueness_o_orderkey" AND NOT "foreign_key_o_custkey"
        GROUP BY o_custkey, order_date_text""",
        "dirty_orders",
    ),
    "quarantine_split": with_views(
        f"""
        SELECT 'valid' AS verdict, NULL AS reason, o_orderkey FROM {FLAGGED} WHERE len({ALL_SQL}) = 0
        UNION ALL SELECT 'quarantine', unnest({ALL_SQL}) AS reason, o_orderkey FROM {FLAGGED}""",
        "dirty_orders",
    ),
    "null_or_blank": with_views(
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL{extra}) AS null_or_blank FROM dirty_orders"
            for c, extra in [
                ("o_orderkey", ""), ("o_custkey", ""), ("o_orderstatus", " OR o_orderstatus = ''"), ("o_totalprice", ""),
                ("o_orderdate", ""), ("ship_date", ""), ("order_date_text", " OR order_date_text = ''"),
                ("email", " OR email = ''"), ("empty_col", " OR empty_col = ''"),
            ]
        ),
        "dirty_orders",
    ),
    "duplicate_groups": with_views(
        "SELECT *, count(*) AS count FROM dup_customer GROUP BY ALL HAVING count(*) > 1", "dup_customer"
    ),
    "duplicate_rate": with_views(
        """
        SELECT (SELECT count(*) FROM dup_customer) AS rows, count(*) AS distinct_rows,
          round(((SELECT count(*) FROM dup_customer) - count(*))::DOUBLE / (SELECT count(*) FROM dup_customer), 6) AS duplicate_rate
        FROM (SELECT DISTINCT * FROM dup_customer) AS d""",
        "dup_customer",
    ),
    "timeliness": """
        SELECT count(*) AS rows, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS recent_rows,
          round(100.0 * count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) / count(*), 2) AS timeliness
        FROM events""",
    "detection_precision_recall": with_views(
        f"""
        WITH expected AS ({EXPECTED_SQL}),
        detected AS (
          SELECT o_orderkey, 'NULL_VALUE' AS problem_type FROM dirty_orders WHERE o_totalprice IS NULL
          UNION ALL SELECT o_orderkey, 'OUT_OF_RANGE' FROM dirty_orders WHERE o_totalprice < 0 OR o_totalprice > 450000
          UNION ALL SELECT o_orderkey, 'INVALID_FORMAT' FROM dirty_orders WHERE order_date_text = 'not a date'
          UNION ALL SELECT o_orderkey, 'INCONSISTENT' FROM dirty_orders WHERE NOT (ship_date > o_orderdate)
          UNION ALL SELECT o_orderkey, 'MISSING_FK' FROM {FLAGGED} WHERE "foreign_key_o_custkey"
          UNION ALL SELECT o_orderkey, 'WRONG_TYPE' FROM dirty_orders WHERE order_date_text IS NOT NULL AND TRY_CAST(order_date_text AS DATE) IS NULL
          UNION ALL SELECT o_orderkey, 'DUPLICATE' FROM {FLAGGED} WHERE n_pair > 1
        ),
        m AS (
          SELECT coalesce(e.problem_type, d.problem_type) AS problem_type,
            count(*) FILTER (WHERE e.o_orderkey IS NOT NULL AND d.o_orderkey IS NOT NULL) AS true_positives,
            count(*) FILTER (WHERE e.o_orderkey IS NULL) AS false_positives,
            count(*) FILTER (WHERE d.o_orderkey IS NULL) AS false_negatives
          FROM expected e FULL OUTER JOIN detected d ON e.o_orderkey = d.o_orderkey AND e.problem_type = d.problem_type
          GROUP BY 1
        )
        SELECT *, round(coalesce(true_positives::DOUBLE / nullif(true_positives + false_positives, 0), 0.0), 4) AS precision,
          round(coalesce(true_positives::DOUBLE / nullif(true_positives + false_negatives, 0), 0.0), 4) AS recall
        FROM m""",
        "dirty_orders",
    ),
}
