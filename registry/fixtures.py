"""Input views shared by the queries and their SQL.

The given tables are clean, so the views below put defects into them: the
CASE expressions change values of rows, no row of a table is left out except
where missing or extra keys are the defect itself (``target_orders``).
The text is the same for Spark and DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# nulls, blanks, bad codes, negative and infinite amounts, bad dates and e-mails
VIEWS["dirty_orders"] = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 41 = 0 THEN 'X' WHEN o_orderkey % 61 = 0 THEN '  ' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 37 = 0 THEN -o_totalprice WHEN o_orderkey % 43 = 0 THEN NULL
       WHEN o_orderkey % 67 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 47 = 0 THEN o_orderdate - INTERVAL '5' DAY ELSE o_orderdate + INTERVAL '3' DAY END AS ship_date,
  CASE WHEN o_orderkey % 31 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date_text,
  CASE WHEN o_orderkey % 23 = 0 THEN 'bad-email' ELSE concat('user', CAST(o_custkey AS STRING), '@example.com') END AS email,
  CAST(NULL AS STRING) AS empty_col
FROM orders
"""

VIEWS["gold_orders"] = """
SELECT concat('Órder-', CAST(o_orderkey AS STRING)) AS order_ref, o_orderpriority, o_totalprice,
  CAST(o_custkey AS DOUBLE) AS cust_num
FROM orders
"""

# The target lost the low-priority pending orders, holds an older copy of the
# urgent finished ones, and has keys of its own for the medium open ones.
VIEWS["target_orders"] = """
SELECT concat('  ÓRDER-', CAST(o_orderkey AS STRING), ' ') AS order_ref, o_orderpriority,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1.0
       WHEN o_orderkey % 10 = 3 THEN o_totalprice + 0.01 ELSE o_totalprice END AS o_totalprice,
  CAST(o_custkey AS DOUBLE) AS cust_num, 1 AS seq
FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
UNION ALL
SELECT concat('order-', CAST(o_orderkey AS STRING)), o_orderpriority, o_totalprice, CAST(o_custkey AS DOUBLE) + 7, 0
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
UNION ALL
SELECT concat('extra-', CAST(o_orderkey AS STRING)), o_orderpriority, o_totalprice, CAST(o_custkey AS DOUBLE), 1
FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM'
"""

VIEWS["dirty_text"] = """
SELECT p_partkey,
  CASE WHEN p_partkey % 5 = 0 THEN concat('  ', p_name, chr(9)) WHEN p_partkey % 7 = 0 THEN '   '
       WHEN p_partkey % 11 = 0 THEN concat('Açúcar ', p_name) ELSE p_name END AS name_text,
  CASE p_partkey % 5
    WHEN 0 THEN concat(CAST(p_partkey + 1 AS STRING), '.', '250', ',50')
    WHEN 1 THEN concat(CAST(p_partkey + 1 AS STRING), ',', '250', '.50')
    WHEN 2 THEN concat(CAST(p_partkey AS STRING), ',75')
    WHEN 3 THEN CAST(p_partkey AS STRING)
    ELSE 'n/a' END AS amount_text,
  CASE p_partkey % 2
    WHEN 0 THEN concat(CAST(p_size AS STRING), ',5')
    ELSE concat(' ', CAST(p_size AS STRING)) END AS size_text,
  CAST(NULL AS STRING) AS empty_col
FROM part
"""

# order dates written in several ways
VIEWS["date_text"] = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 31 = 0 THEN 'not a date' ELSE
    CASE o_orderkey % 4
      WHEN 0 THEN d
      WHEN 1 THEN concat(substr(d, 6, 2), '/', substr(d, 9, 2), '/', substr(d, 1, 4))
      WHEN 2 THEN concat(substr(d, 1, 4), '/', substr(d, 6, 2), '/', substr(d, 9, 2))
      ELSE concat(d, 'T08:30:00') END
  END AS date_text
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders) AS x
"""

VIEWS["dup_customer"] = """
SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'
"""

VIEWS["checklist_items"] = """
SELECT item_id, concat('ITEM_', CAST(item_id AS STRING)) AS code, text AS title,
  concat('dim_', CAST(item_id % 7 AS STRING)) AS dimension, 1 + item_id % 3 AS priority_weight
FROM benchmark
"""

# several marks per (run, item); the two highest item ids are unknown
VIEWS["checklist_marks"] = """
SELECT user_id % 20 AS run_id, event_id % (SELECT count(*) + 2 FROM benchmark) AS item_id,
  CASE WHEN value > 30 THEN 'DONE' ELSE 'NOT_DONE' END AS status, ts, event_id
FROM events
"""

VIEWS["doc_files"] = """
SELECT doc_id, source, n_chars,
  concat(CASE WHEN doc_id % 7 = 0 THEN 'test_' ELSE 'doc_' END, CAST(doc_id AS STRING),
         CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END) AS filename,
  CASE WHEN doc_id % 11 = 0 THEN '   ' WHEN doc_id % 13 = 0 THEN 'Test document about data quality'
       WHEN doc_id % 3 = 0 THEN concat('# ', source, ' report ', chr(10), text) ELSE text END AS text
FROM documents
"""

VIEWS["search_queries"] = """
SELECT item_id AS query_id,
  concat(CASE item_id % 4 WHEN 0 THEN 'data quality issues: ' WHEN 1 THEN 'qualidade dos dados? '
         WHEN 2 THEN 'null validation ' ELSE '' END, text) AS query
FROM benchmark
UNION ALL
SELECT -1 - r_regionkey, concat('zzzz', CAST(r_regionkey AS STRING)) FROM region
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the given tables, handed over by name, so that no view of the session is touched."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for table in used:
        sql = re.sub(rf"(?i)\b(FROM|JOIN)\s+{table}\b(?!\s*\.)", rf"\1 {{{table}}} AS {table}", sql)
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in used})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the views above."""
    return load(spark, sf_dir, name) if name in TABLES else run_sql(spark, sf_dir, VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """The SQL with the named views in front."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
