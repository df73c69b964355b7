"""Checklist coverage of the runs."""

from __future__ import annotations

from tidemark.operators import checklist as K

from .fixtures import view, with_views
from .text import SCORES


def _latest(spark, sf_dir):
    return K.latest_marks(view(spark, sf_dir, "checklist_marks"), ["ts", "event_id"])


def _on_items(operator):
    return lambda spark, sf_dir: operator(_latest(spark, sf_dir), view(spark, sf_dir, "checklist_items"))


def checklist_recommendations(spark, sf_dir):
    return K.recommendations(
        _latest(spark, sf_dir), view(spark, sf_dir, "checklist_items"), view(spark, sf_dir, "doc_files")
    )


QUERIES = {
    "checklist_latest_marks": _latest,
    "checklist_coverage": _on_items(K.coverage),
    "checklist_by_dimension": _on_items(K.coverage_by_dimension),
    "checklist_missing": _on_items(K.missing_items),
    "checklist_recommendations": checklist_recommendations,
}

LATEST = "latest AS (SELECT run_id, item_id, arg_max(status, (ts, event_id)) AS status FROM checklist_marks GROUP BY run_id, item_id)"
GRID = f"{LATEST}, grid AS (SELECT r.run_id, i.* FROM (SELECT DISTINCT run_id FROM latest) r, checklist_items i)"


def _sql(body):
    return with_views(f"WITH {GRID} {body}", "checklist_items", "checklist_marks")


RECOMMENDED = f"""WITH {GRID},
open_items AS (SELECT g.run_id, g.code, g.title, row_number() OVER (PARTITION BY g.run_id ORDER BY priority_weight DESC, g.item_id) AS place
  FROM grid g LEFT JOIN latest l ON g.run_id = l.run_id AND g.item_id = l.item_id WHERE status IS DISTINCT FROM 'DONE'),
first_items AS (SELECT run_id, list(code ORDER BY place) AS missing_codes,
  '{K.ADVICE_QUERY}' || string_agg(code || ': ' || title, chr(10) ORDER BY place) AS query FROM open_items WHERE place <= 5 GROUP BY run_id),
search_queries AS (SELECT run_id AS query_id, query FROM first_items),
documents AS (SELECT doc_id, text FROM doc_files),
{SCORES}
SELECT t.run_id, missing_codes, sources FROM first_items t LEFT JOIN (
  SELECT query_id, list(filename ORDER BY rank) AS sources FROM hits JOIN doc_files ON hits.doc_id = doc_files.doc_id WHERE rank <= 3 GROUP BY query_id
) AS s ON s.query_id = t.run_id"""

ORACLE = {
    "checklist_recommendations": with_views(RECOMMENDED, "checklist_items", "checklist_marks", "doc_files"),
    "checklist_latest_marks": _sql("SELECT * FROM latest"),
    "checklist_coverage": _sql(
        """SELECT run_id, (SELECT count(*) FROM checklist_items) AS total_items, count(*) FILTER (WHERE status = 'DONE') AS done_items,
          round(100.0 * count(*) FILTER (WHERE status = 'DONE') / (SELECT count(*) FROM checklist_items), 1)::DOUBLE AS coverage FROM latest GROUP BY run_id"""),
    "checklist_by_dimension": _sql(
        """SELECT g.run_id, dimension, count(*) FILTER (WHERE status = 'DONE') AS done, count(*) AS total,
          round(100.0 * count(*) FILTER (WHERE status = 'DONE') / count(*), 1)::DOUBLE AS coverage
        FROM grid g LEFT JOIN latest l ON g.run_id = l.run_id AND g.item_id = l.item_id GROUP BY ALL"""),
    "checklist_missing": _sql(
        """SELECT g.run_id, g.item_id, dimension, priority_weight, CAST(row_number() OVER (PARTITION BY g.run_id ORDER BY priority_weight DESC, g.item_id) AS INT) AS place
        FROM grid g LEFT JOIN latest l ON g.run_id = l.run_id AND g.item_id = l.item_id WHERE status IS DISTINCT FROM 'DONE'"""),
}
