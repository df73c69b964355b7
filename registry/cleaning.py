"""Column operators, schema checks and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import timestamp_from_text
from tidemark.functions.numbers import number_from_text
from tidemark.functions.text import normalize_key, strip_accents, trim_invisible
from tidemark.operators import cleaning as C
from tidemark.operators import headers, schema

from tidemark.session import scratch_path

from .fixtures import view, with_views


def normalize_headers(spark, sf_dir):
    raw = view(spark, sf_dir, "customer").toDF("Cust Key", " Nome-Completo ", "Região", "Saldo (R$)", "regiao")
    return headers.normalize_headers(raw)


EXPECTED = {"o_orderkey": "long", "o_custkey": "string", "order_date_text": "date", "email": "string", "o_totalprice": "double", "discount": "double"}


def schema_conformance(spark, sf_dir):
    return schema.schema_conformance(view(spark, sf_dir, "dirty_orders"), EXPECTED)


def _accented(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", strip_accents(F.col("text")).alias("plain"))


def normalize_keys(spark, sf_dir):
    return view(spark, sf_dir, "dirty_text").select("p_partkey", normalize_key(F.col("name_text")).alias("key"))


def coerce_numeric(spark, sf_dir):
    return view(spark, sf_dir, "dirty_text").select("p_partkey", number_from_text(F.col("amount_text")).alias("amount"))


def trim_text(spark, sf_dir):
    return view(spark, sf_dir, "dirty_text").select("p_partkey", trim_invisible(F.col("name_text")).alias("name"))


def parse_dates(spark, sf_dir):
    parsed = timestamp_from_text(F.col("date_text")).cast("date").cast("string")
    return view(spark, sf_dir, "date_text").select("o_orderkey", parsed.alias("parsed"))


def coerce_types(spark, sf_dir):
    cells = view(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit(" "), F.col("o_totalprice").cast("string")).alias("whole"),
        F.when(F.col("o_orderkey") % 5 == 0, "none").when(F.col("o_orderkey") % 7 == 0, "n/a")
        .otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "no").otherwise(" NULL ").alias("flag"),
        F.col("o_orderpriority").alias("day"),
    )
    return schema.coerce_types(cells, {"whole": "integer", "price": "price", "flag": "boolean", "day": "date"})


def _cleaned(spark, sf_dir):
    return C.clean_dataset(view(spark, sf_dir, "dirty_text"))


def clean_numeric(spark, sf_dir):
    return C.clean_dataset(view(spark, sf_dir, "dirty_text"), C.CleanOptions(parse_dates=False)).data


def drop_empty_columns(spark, sf_dir):
    data = C.drop_empty_columns(view(spark, sf_dir, "dirty_orders"))
    # times as text on both sides
    return data.select(*[F.col(n).cast("string").alias(n) if kind.startswith("timestamp") else F.col(n) for n, kind in data.dtypes])


def clean_dates(spark, sf_dir):
    data = C.clean_dataset(view(spark, sf_dir, "date_text"), C.CleanOptions(keep_unparsed=True)).data
    return data.withColumn("date_text", F.col("date_text").cast("date").cast("string"))


def cleaning_observed(spark, sf_dir):
    """The report, counted while the cleaned rows are written."""
    return C.write_clean(view(spark, sf_dir, "dirty_text"), scratch_path(spark, "cleaned")).report


def written_clean(spark, sf_dir):
    return C.write_clean(view(spark, sf_dir, "dirty_text"), scratch_path(spark, "cleaned")).data


def trim_counts(spark, sf_dir):
    return _cleaned(spark, sf_dir).report.select("column", "trimmed")


QUERIES = {
    "normalize_headers": normalize_headers,
    "schema_conformance": schema_conformance,
    "strip_accents": _accented,
    "normalize_keys": normalize_keys,
    "coerce_numeric": coerce_numeric,
    "trim_invisible": trim_text,
    "parse_dates": parse_dates,
    "coerce_types": coerce_types,
    "drop_empty_columns": drop_empty_columns,
    "clean_trim_counts": trim_counts,
    "clean_numeric": clean_numeric,
    "clean_dates": clean_dates,
    "clean_drop_duplicates": lambda spark, sf_dir: C.clean_dataset(
        view(spark, sf_dir, "dup_customer"), C.CleanOptions(drop_duplicates=True)).data,
    "cleaning_report": lambda spark, sf_dir: _cleaned(spark, sf_dir).report,
    "cleaning_observed": cleaning_observed,
    "clean_written": written_clean,
    "cleaning_totals": lambda spark, sf_dir: C.clean_dataset(
        view(spark, sf_dir, "dup_customer").withColumn("Empty Col", F.lit(None).cast("string")),
        C.CleanOptions(drop_duplicates=True)).totals,
    "clean_dataset": lambda spark, sf_dir: _cleaned(spark, sf_dir).data,
}

INVISIBLE_SQL = "[\\x00-\\x1f\\x7f-\\x{9f}\\x{200b}-\\x{200f}\\x{feff}]"


def _trim_sql(column):
    return f"nullif(trim(regexp_replace({column}, '{INVISIBLE_SQL}', '', 'g')), '')"


NUMBER_SQL = """try_cast(CASE
  WHEN strpos({c}, ',') > 0 AND strpos({c}, '.') > 0 THEN
    CASE WHEN strpos(reverse({c}), ',') < strpos(reverse({c}), '.') THEN replace(replace({c}, '.', ''), ',', '.') ELSE replace({c}, ',', '') END
  WHEN strpos({c}, ',') > 0 THEN
    CASE WHEN length({c}) - length(replace({c}, ',', '')) = 1 AND strpos(reverse({c}), ',') <= 4 THEN replace({c}, ',', '.') ELSE replace({c}, ',', '') END
  ELSE {c} END AS DOUBLE)"""
DATE_SQL = "try_strptime(date_text, ['%Y-%m-%d', '%m/%d/%Y', '%Y/%m/%d', '%Y-%m-%dT%H:%M:%S'])"
NAME, AMOUNT, SIZE = (_trim_sql(c) for c in ("name_text", "amount_text", "size_text"))

ORACLE = {
    "normalize_headers": "SELECT c_custkey AS cust_key, c_name AS nome_completo, c_nationkey AS regiao, c_acctbal AS saldo_r, c_mktsegment AS regiao_2 FROM customer",
    "schema_conformance": with_views(
        """
        SELECT 'o_orderkey' AS "column", 'bigint' AS expected_type, 'bigint' AS actual_type, 'ok' AS status, 0::BIGINT AS bad_values
        UNION ALL SELECT 'o_custkey', 'string', 'bigint', 'type_differs', 0
        UNION ALL SELECT 'order_date_text', 'date', 'string', 'type_differs', count(*) FILTER (WHERE order_date_text IS NOT NULL AND try_cast(order_date_text AS DATE) IS NULL) FROM dirty_orders
        UNION ALL SELECT 'email', 'string', 'string', 'ok', 0
        UNION ALL SELECT 'o_totalprice', 'double', 'double', 'ok', 0
        UNION ALL SELECT 'discount', 'double', NULL, 'missing', 0
        UNION ALL SELECT 'o_orderstatus', NULL, 'string', 'unexpected', 0
        UNION ALL SELECT 'o_orderdate', NULL, 'timestamp_ntz', 'unexpected', 0
        UNION ALL SELECT 'ship_date', NULL, 'timestamp_ntz', 'unexpected', 0
        UNION ALL SELECT 'empty_col', NULL, 'string', 'unexpected', 0""",
        "dirty_orders",
    ),
    "strip_accents": "SELECT doc_id, strip_accents(text) AS plain FROM documents",
    "normalize_keys": with_views(
        "SELECT p_partkey, regexp_replace(strip_accents(lower(trim(coalesce(regexp_replace(name_text, '^\\s+|\\s+$', '', 'g'), '')))), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS key FROM dirty_text",
        "dirty_text",
    ),
    "coerce_numeric": with_views(f"SELECT p_partkey, {NUMBER_SQL.format(c='amount_text')} AS amount FROM dirty_text", "dirty_text"),
    "trim_invisible": with_views(f"SELECT p_partkey, {NAME} AS name FROM dirty_text", "dirty_text"),
    "parse_dates": with_views(f"SELECT o_orderkey, CAST(CAST({DATE_SQL} AS DATE) AS VARCHAR) AS parsed FROM date_text", "date_text"),
    "coerce_types": """
        SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole,
          CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
          CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag, o_orderpriority AS day
        FROM orders""",
    "drop_empty_columns": with_views(
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, CAST(ship_date AS VARCHAR) AS ship_date, order_date_text, email FROM dirty_orders", "dirty_orders"),
    "clean_trim_counts": with_views(
        "\nUNION ALL\n".join(
            [f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_trim_sql(c)} IS DISTINCT FROM {c}) AS trimmed FROM dirty_text"
             for c in ("name_text", "amount_text", "size_text", "empty_col")] + ["SELECT 'p_partkey', 0"]
        ),
        "dirty_text",
    ),
    "clean_numeric": with_views(
        f"SELECT p_partkey, {NAME} AS name_text, {NUMBER_SQL.format(c=f'({SIZE})')} AS size_text, {AMOUNT} AS amount_text FROM dirty_text", "dirty_text"),
    "clean_dates": with_views(
        f"SELECT o_orderkey, CAST(CAST({DATE_SQL} AS DATE) AS VARCHAR) AS date_text, CASE WHEN {DATE_SQL} IS NULL THEN date_text END AS date_text__unparsed FROM date_text",
        "date_text"),
    "clean_drop_duplicates": with_views("SELECT DISTINCT * FROM dup_customer", "dup_customer"),
    "cleaning_report": with_views(
        f"""
        SELECT 'p_partkey' AS "column", false AS removed, 0::BIGINT AS nulls_before, 0::BIGINT AS nulls_after, 0::BIGINT AS trimmed,
          0::BIGINT AS made_numeric, 0::BIGINT AS parsed_dates, 0::BIGINT AS unparsed_dates
        UNION ALL SELECT 'name_text', false, count(*) - count(name_text), count(*) - count({NAME}), count(*) FILTER (WHERE {NAME} IS DISTINCT FROM name_text), 0, 0, 0 FROM dirty_text
        UNION ALL SELECT 'amount_text', false, count(*) - count(amount_text), count(*) - count({AMOUNT}), count(*) FILTER (WHERE {AMOUNT} IS DISTINCT FROM amount_text), 0, 0, 0 FROM dirty_text
        UNION ALL SELECT 'size_text', false, count(*) - count(size_text), count(*) - count({SIZE}), count(*) FILTER (WHERE {SIZE} IS DISTINCT FROM size_text),
          count(*) FILTER (WHERE strpos(size_text, ',') > 0), 0, 0 FROM dirty_text
        UNION ALL SELECT 'empty_col', true, count(*), NULL, 0, 0, 0, 0 FROM dirty_text""",
        "dirty_text",
    ),
    "cleaning_totals": with_views(
        """SELECT (SELECT count(*) FROM dup_customer) AS rows_read, (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_customer) d) AS rows_written,
          6::BIGINT AS columns_before, 5::BIGINT AS columns_after, 'empty_col' AS removed_columns""", "dup_customer"),
    "clean_dataset": with_views(
        f"SELECT p_partkey, {NAME} AS name_text, {AMOUNT} AS amount_text, {NUMBER_SQL.format(c=f'({SIZE})')} AS size_text FROM dirty_text", "dirty_text"),
}
ORACLE["cleaning_observed"], ORACLE["clean_written"] = ORACLE["cleaning_report"], ORACLE["clean_dataset"]
