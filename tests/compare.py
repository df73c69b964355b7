"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import math


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))


def same(spark_df, duck_result):
    duck_names = [d[0] for d in duck_result.description]
    assert sorted(spark_df.columns) == sorted(duck_names)
    ours, theirs = _rows(spark_df.columns, spark_df.collect()), _rows(duck_names, duck_result.fetchall())
    assert len(ours) == len(theirs)
    differing = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not differing, differing[:3]
    return len(ours)
