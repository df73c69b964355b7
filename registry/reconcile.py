"""Trusted against target orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reconcile as R

from .fixtures import view, with_views

KEYS = ["order_ref", "o_orderpriority"]
VALUES = ["o_totalprice", "cust_num"]
OPTIONS = R.Options(tolerance=0.05, order_by=["seq"])


def _frames(spark, sf_dir):
    return view(spark, sf_dir, "gold_orders"), view(spark, sf_dir, "target_orders")


def _reconciled(spark, sf_dir, options=OPTIONS):
    gold, target = _frames(spark, sf_dir)
    return R.reconcile(gold, target, KEYS, VALUES, options)


def composite_key(spark, sf_dir):
    _, target = _frames(spark, sf_dir)
    return R.composite_key(target, KEYS).select("order_ref", "seq", "composite_key")


def gold_duplicate_keys(spark, sf_dir):
    """The target has repeated keys; as a trusted side it would be refused."""
    _, target = _frames(spark, sf_dir)
    return R.gold_duplicate_keys(target, KEYS)


def _dedup(policy):
    def query(spark, sf_dir):
        _, target = _frames(spark, sf_dir)
        options = R.Options(duplicate_policy=policy, order_by=["seq"])
        merged = R.merge_duplicates(R.key_columns(target, KEYS), KEYS, VALUES, options)
        return merged.select(
            F.col("__k0").alias("key0"), F.col("__k1").alias("key1"), "order_ref",
            *[F.round(v, 4).alias(v) for v in VALUES],
        )

    return query


def reconcile_status(spark, sf_dir):
    return _reconciled(spark, sf_dir).joined.groupBy("origin").agg(F.count(F.lit(1)).alias("rows"))


def compare_tolerance(spark, sf_dir):
    joined = _reconciled(spark, sf_dir).joined.filter("origin = 'both'")
    return joined.select(
        F.col("__k0").alias("key0"),
        *[R.mismatch(F.col(v), F.col(f"__g_{v}"), 0.05).alias(f"{v}_wrong") for v in VALUES],
    )


def diff_rows(spark, sf_dir):
    diffs = R.flat_diffs(_reconciled(spark, sf_dir).diffs)
    return diffs.withColumn("delta", F.round("delta", 4))


def diff_top_n(spark, sf_dir):
    diffs = R.flat_diffs(R.diff_top_n(_reconciled(spark, sf_dir).diffs, 100))
    return diffs.withColumn("delta", F.round("delta", 4))


QUERIES = {
    "composite_key": composite_key,
    "gold_duplicate_keys": gold_duplicate_keys,
    "dedup_keep_last": _dedup("keep_last"),
    "dedup_sum": _dedup("sum"),
    "dedup_mean": _dedup("mean"),
    "reconcile_status": reconcile_status,
    "compare_tolerance": compare_tolerance,
    "diff_rows": diff_rows,
    "diff_top_n": diff_top_n,
    "corrected_target": lambda spark, sf_dir: _reconciled(spark, sf_dir).corrected,
    "accuracy_summary": lambda spark, sf_dir: _reconciled(spark, sf_dir).summary,
    "accuracy_summary_mean": lambda spark, sf_dir: _reconciled(
        spark, sf_dir, R.Options(tolerance=0.05, duplicate_policy="mean", null_equals_zero=False)).summary,
}

KEY_SQL = "regexp_replace(strip_accents(lower(trim({c}))), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
K0, K1 = KEY_SQL.format(c="order_ref"), KEY_SQL.format(c="o_orderpriority")

KEYED = f"""
keyed AS (SELECT {K0} AS key0, {K1} AS key1, * FROM target_orders),
kept AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key0, key1 ORDER BY seq DESC) = 1),
gold AS (SELECT {K0} AS key0, {K1} AS key1, o_totalprice AS g_price, cust_num AS g_cust FROM gold_orders)"""

JOINED = KEYED + """,
joined AS (SELECT coalesce(t.key0, g.key0) AS key0, coalesce(t.key1, g.key1) AS key1, t.order_ref, t.o_orderpriority, t.seq, t.o_totalprice, t.cust_num, g.g_price, g.g_cust,
  CASE WHEN t.key0 IS NULL THEN 'missing_in_target' WHEN g.key0 IS NULL THEN 'extra_in_target' ELSE 'both' END AS origin
  FROM kept t FULL OUTER JOIN gold g ON t.key0 = g.key0 AND t.key1 = g.key1),
marked AS (SELECT *, origin = 'both' AND abs(coalesce(o_totalprice, 0) - coalesce(g_price, 0)) > 0.05 AS wrong_price,
  origin = 'both' AND abs(coalesce(cust_num, 0) - coalesce(g_cust, 0)) > 0.05 AS wrong_cust FROM joined),
diffs AS (
  SELECT order_ref, o_orderpriority, 'o_totalprice' AS "column", g_price AS gold, o_totalprice AS target, round(g_price, 2) AS corrected, round(abs(g_price - o_totalprice), 4) AS delta FROM marked WHERE wrong_price
  UNION ALL
  SELECT order_ref, o_orderpriority, 'cust_num', g_cust, cust_num, round(g_cust, 2), round(abs(g_cust - cust_num), 4) FROM marked WHERE wrong_cust)"""


def _sql(body, chain=JOINED):
    return with_views(f"WITH {chain}\n{body}", "gold_orders", "target_orders")


def _grouped(function):
    return _sql(
        f"SELECT key0, key1, min(order_ref) AS order_ref, round(coalesce({function}(o_totalprice), {'0.0' if function == 'sum' else 'NULL'}), 4) AS o_totalprice, "
        f"round(coalesce({function}(cust_num), {'0.0' if function == 'sum' else 'NULL'}), 4) AS cust_num FROM keyed GROUP BY key0, key1",
        KEYED,
    )


ORACLE = {
    "composite_key": _sql("SELECT order_ref, seq, key0 || '||' || key1 AS composite_key FROM keyed", KEYED),
    "gold_duplicate_keys": _sql(
        "SELECT key0 || '||' || key1 AS composite_key, count(*) AS count FROM keyed GROUP BY 1 HAVING count(*) > 1", KEYED),
    "dedup_keep_last": _sql("SELECT key0, key1, order_ref, round(o_totalprice, 4) AS o_totalprice, round(cust_num, 4) AS cust_num FROM kept", KEYED),
    "dedup_sum": _grouped("sum"),
    "dedup_mean": _grouped("avg"),
    "reconcile_status": _sql("SELECT origin, count(*) AS rows FROM joined GROUP BY origin"),
    "compare_tolerance": _sql("SELECT key0, wrong_price AS o_totalprice_wrong, wrong_cust AS cust_num_wrong FROM marked WHERE origin = 'both'"),
    "diff_rows": _sql("SELECT * FROM diffs"),
    "diff_top_n": _sql("SELECT * FROM diffs ORDER BY order_ref, o_orderpriority, \"column\" LIMIT 100"),
    "corrected_target": _sql(
        "SELECT order_ref, o_orderpriority, seq, CASE WHEN wrong_price THEN round(g_price, 2) ELSE o_totalprice END AS o_totalprice, "
        "CASE WHEN wrong_cust THEN round(g_cust, 2) ELSE cust_num END AS cust_num FROM marked WHERE origin <> 'missing_in_target'"),
    "accuracy_summary": _sql(
        """SELECT count(*) FILTER (WHERE origin <> 'extra_in_target') AS rows_gold, count(*) FILTER (WHERE origin <> 'missing_in_target') AS rows_target,
          count(*) FILTER (WHERE origin = 'both') AS common_keys, count(*) FILTER (WHERE origin = 'missing_in_target') AS missing_in_target,
          count(*) FILTER (WHERE origin = 'extra_in_target') AS extra_in_target,
          count(*) FILTER (WHERE wrong_price) + count(*) FILTER (WHERE wrong_cust) AS mismatches_total,
          round(1 - (count(*) FILTER (WHERE wrong_price) + count(*) FILTER (WHERE wrong_cust))::DOUBLE / (2 * count(*) FILTER (WHERE origin = 'both')), 4) AS accuracy
        FROM marked"""),
    "accuracy_summary_mean": _sql(
        f"""SELECT count(*) FILTER (WHERE origin <> 'extra_in_target') AS rows_gold, count(*) FILTER (WHERE origin <> 'missing_in_target') AS rows_target,
          count(*) FILTER (WHERE origin = 'both') AS common_keys, count(*) FILTER (WHERE origin = 'missing_in_target') AS missing_in_target,
          count(*) FILTER (WHERE origin = 'extra_in_target') AS extra_in_target,
          sum(w1 + w2)::BIGINT AS mismatches_total, round(1 - sum(w1 + w2)::DOUBLE / (2 * count(*) FILTER (WHERE origin = 'both')), 4) AS accuracy
        FROM (
          SELECT CASE WHEN t.key0 IS NULL THEN 'missing_in_target' WHEN g.key0 IS NULL THEN 'extra_in_target' ELSE 'both' END AS origin,
            CASE WHEN t.key0 IS NULL OR g.key0 IS NULL OR abs(p - g_price) <= 0.05 THEN 0 ELSE 1 END AS w1,
            CASE WHEN t.key0 IS NULL OR g.key0 IS NULL OR abs(c - g_cust) <= 0.05 THEN 0 ELSE 1 END AS w2
          FROM (SELECT key0, key1, avg(o_totalprice) AS p, avg(cust_num) AS c FROM keyed GROUP BY key0, key1) t
          FULL OUTER JOIN gold g ON t.key0 = g.key0 AND t.key1 = g.key1) AS x"""),
}
