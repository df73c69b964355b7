"""Synthetic rows, one for every row of a table, and uniqueness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import synth as S
from tidemark.operators import unique as U

from .fixtures import view

ROWS = [
    {"name": "quantity", "type": "integer", "options": {"min": -50, "max": 5_000_000_000}},
    {"name": "score", "type": "integer"},
    {"name": "price", "type": "price", "options": {"min": 10, "max": 500}},
    {"name": "ratio", "type": "float", "options": {"min": 0, "max": 1, "decimals": 4}},
    {"name": "active", "type": "boolean"},
    {"name": "day", "type": "date", "options": {"start": "2024-12-31", "end": "2024-01-01"}},
    {"name": "moment", "type": "datetime", "options": {"start": "2023-01-01", "end": "2024-12-31"}},
    {"name": "token", "type": "uuid"},
]
TEXT = [
    {"name": "name", "type": "string", "options": {"vocabulary": ["red", "green", "blue"]}},
    {"name": "padded", "type": "string", "options": {"length": 12}},
    {"name": "email", "type": "email"},
    {"name": "phone", "type": "phone"},
    {"name": "address", "type": "address"},
    {"name": "product", "type": "product_name"},
    {"name": "code", "type": "custom_pattern", "options": {"pattern": "??-###"}},
    {"name": "kind", "type": "category", "options": {"categories": ["a", "b", "c"]}},
]
WEIGHTS = [{"name": "tier", "type": "category", "options": {"categories": {"gold": 1, "silver": 3, "bronze": 6}}}]
NULLS = [
    {"name": "maybe", "type": "integer", "options": {"min": 1, "max": 9, "allow_nulls": 25}},
    {"name": "rarely", "type": "category", "options": {"categories": ["x", "y"], "allow_nulls": 5}},
]
#: Rows whose values one task tells apart.
TASK_ROWS = 1_000_000


def _for_orders(spec):
    def query(spark, sf_dir):
        ids = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
        return S.synthesize(ids, spec, seed=7, keep_id=True)

    return query


def synth_unique(spark, sf_dir):
    """As many rows as lineitem has; the row count is exact and no value repeats."""
    rows = view(spark, sf_dir, "lineitem").count()
    # ten times as many codes as rows
    highest = 10 * rows
    unique = [
        {"name": "code", "type": "integer", "options": {"min": 1, "max": highest, "unique": True}},
        {"name": "email", "type": "email", "options": {"unique": True}},
    ]
    made = S.generate(spark, unique, rows)
    # every value in one of so many partitions: a task counts those of a bounded number of rows
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    emails = made.select("email").repartition(tasks, "email").distinct().agg(F.count("email").alias("emails"))
    codes = made.select("code").repartition(tasks, "code").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    facts = codes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("code").alias("codes"),
        ((F.min("code") >= 1) & (F.max("code") <= highest)).alias("in_range"),
    )
    # a row on either side
    return facts.crossJoin(F.broadcast(emails)).select("rows", "codes", "emails", "in_range")


def enforce_unique_single(spark, sf_dir):
    return U.enforce_unique(view(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey")


def _banded(spark, sf_dir):
    band = F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 250)).alias("band")
    return view(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", band)


def enforce_unique_multi(spark, sf_dir):
    return U.enforce_unique(_banded(spark, sf_dir), ["o_custkey", "band"], "o_orderkey")


def enforce_unique_multi_proof(spark, sf_dir):
    """Kept values that occur twice, dropped rows without a kept earlier row of the same value, and all rows: 0, 0, rows."""
    lines = _banded(spark, sf_dir)
    kept = U.enforce_unique(lines, ["o_custkey", "band"], "o_orderkey")
    judged = lines.join(kept.select("o_orderkey", F.lit(True).alias("kept")), "o_orderkey", "left")
    for name in ("o_custkey", "band"):
        held = kept.filter(F.col(name).isNotNull()).groupBy(name)
        judged = judged.join(held.agg(F.min("o_orderkey").alias(f"first_{name}"), F.count(F.lit(1)).alias(f"n_{name}")), name, "left")
    dropped = F.col("kept").isNull()
    earlier = F.coalesce(F.least("first_o_custkey", "first_band") < F.col("o_orderkey"), F.lit(False))
    repeated = ~dropped & (F.greatest(F.coalesce("n_o_custkey", F.lit(1)), F.coalesce("n_band", F.lit(1))) > 1)
    return judged.agg(
        F.count_if(repeated).alias("repeated"), F.count_if(dropped & ~earlier).alias("dropped_without_cause"), F.count(F.lit(1)).alias("rows")
    )


QUERIES = {
    "synth_rows": _for_orders(ROWS),
    "synth_text": _for_orders(TEXT),
    "synth_category_weights": _for_orders(WEIGHTS),
    "synth_nulls": _for_orders(NULLS),
    "synth_unique": synth_unique,
    "enforce_unique_single": enforce_unique_single,
    "enforce_unique_multi": enforce_unique_multi,
    "enforce_unique_multi_proof": enforce_unique_multi_proof,
}


def _draw(name: str) -> str:
    return f"CAST('0x' || substr(md5(o_orderkey || ':7:{name}'), 1, 12) AS BIGINT)"


def _unit(name: str) -> str:
    return f"({_draw(name)} / 281474976710656.0::DOUBLE)"


def _pick(values, name):
    return f"[{', '.join(repr(v) for v in values)}][({_draw(name)} % {len(values)}) + 1]"


def _padded(name, n, width):
    return f"lpad(CAST({_draw(name)} % {n} AS VARCHAR), {width}, '0')"


_TOKEN = "md5(o_orderkey || ':7:token')"
_TIME = f"({_draw('moment:time')} % 86400)"

ORACLE = {
    "synth_rows": f"""
        SELECT o_orderkey AS id, {_draw('quantity')} % 5000000051 - 50 AS quantity, {_draw('score')} % 101 AS score,
          round({_unit('price')} * 490.0::DOUBLE + 10.0::DOUBLE, 2) AS price, round({_unit('ratio')}, 4) AS ratio,
          {_draw('active')} % 2 = 0 AS active,
          strftime(DATE '2024-01-01' + CAST({_draw('day')} % 366 AS INT), '%Y-%m-%d') AS day,
          strftime(DATE '2023-01-01' + CAST({_draw('moment')} % 731 AS INT), '%Y-%m-%d') || ' ' || lpad(CAST({_TIME} // 3600 AS VARCHAR), 2, '0')
            || ':' || lpad(CAST({_TIME} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({_TIME} % 60 AS VARCHAR), 2, '0') AS moment,
          concat_ws('-', substr({_TOKEN}, 1, 8), substr({_TOKEN}, 9, 4), substr({_TOKEN}, 13, 4), substr({_TOKEN}, 17, 4), substr({_TOKEN}, 21, 12)) AS token
        FROM orders""",
    "synth_text": f"""
        SELECT o_orderkey AS id, {_pick(['red', 'green', 'blue'], 'name')} AS name,
          substr(repeat({_pick(S.WORDS, 'padded:first')} || ' ' || {_pick(S.WORDS, 'padded:second')} || ' ', 12), 1, 12) AS padded,
          {_pick(S.FIRST, 'email:first')} || '.' || {_pick(S.LAST, 'email:last')} || ({_draw('email:number')} % 10000) || '@example.com' AS email,
          '(' || {_padded('phone:area', 90, 2)} || ') 9' || {_padded('phone:head', 10000, 4)} || '-' || {_padded('phone:tail', 10000, 4)} AS phone,
          {_pick(S.STREETS, 'address:street')} || ', ' || ({_draw('address:number')} % 9999 + 1) AS address,
          {_pick(S.ADJECTIVES, 'product:adjective')} || ' ' || {_pick(S.PRODUCTS, 'product:noun')} AS product,
          chr(CAST({_draw('code:0')} % 26 + 65 AS INT)) || chr(CAST({_draw('code:1')} % 26 + 65 AS INT)) || '-'
            || ({_draw('code:3')} % 10) || ({_draw('code:4')} % 10) || ({_draw('code:5')} % 10) AS code,
          {_pick(['a', 'b', 'c'], 'kind')} AS kind
        FROM orders""",
    "synth_category_weights": f"""
        SELECT o_orderkey AS id, CASE WHEN {_unit('tier')} < 0.1 THEN 'gold' WHEN {_unit('tier')} < 0.4 THEN 'silver' ELSE 'bronze' END AS tier FROM orders""",
    "synth_nulls": f"""
        SELECT o_orderkey AS id, CASE WHEN {_unit('maybe:null')} >= 0.25 THEN {_draw('maybe')} % 9 + 1 END AS maybe,
          CASE WHEN {_unit('rarely:null')} >= 0.05 THEN {_pick(['x', 'y'], 'rarely')} END AS rarely FROM orders""",
    "synth_unique": "SELECT count(*) AS rows, count(*) AS codes, count(*) AS emails, true AS in_range FROM lineitem",
    "enforce_unique_multi_proof": "SELECT 0::BIGINT AS repeated, 0::BIGINT AS dropped_without_cause, count(*) AS rows FROM orders",
    "enforce_unique_single": "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey",
}
