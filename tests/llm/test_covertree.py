import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import covertree
from tidemark.llm.covertree import near_vectors, vector_links

from .documents import by_key


def brute(rows, threshold, kind=np.float32):
    links, root, groups = [0] * len(rows), list(range(len(rows))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups[label, len(v)].append(k)
    for members in groups.values():
        m = np.array([rows[k][1] for k in members], kind).astype(np.float64)
        m = np.ldexp(m, -np.frexp(np.abs(m).max(1))[1][:, None])
        norm = np.linalg.norm(m, axis=1)
        near = m @ m.T / norm[:, None] / norm[None] >= threshold
        np.fill_diagonal(near, False)
        for a, k in enumerate(members):
            links[k] = int(near[a].sum())
            for b in np.flatnonzero(near[a]):
                x, y = find(k), find(members[b])
                root[max(x, y)] = min(x, y)
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[find(k)] = min(least.get(find(k), row[0]), row[0])
    return [(r[0], links[k], least.get(find(k)), r[0] == least.get(find(k))) for k, r in enumerate(rows)]


def vectors():
    rng = np.random.default_rng(4)
    base, rows = rng.normal(size=(6, 12)), []
    rows += [(i, (base[i % 6] + rng.normal(size=12) * 0.25).astype(np.float32).tolist(), i % 2) for i in range(240)]
    rows += [(1000 + i, (base[0] * (1 + i)).astype(np.float32).tolist(), 7) for i in range(60)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(3000 + i, rng.normal(size=4).astype(np.float32).tolist(), 1) for i in range(40)]
    rows += [
        (None, rows[0][1], 0), (5, rows[9][1], 1), (6001, None, 1), (6002, [], 1), (6003, [0.0] * 12, 1), (6004, [float("nan")] * 12, 1),
        (6005, [float("inf")] * 12, 1), (6006, rows[0][1], None), (6007, [None] * 12, 1), (6008, [1e-30] * 12, 9), (6009, [1e30] * 12, 9),
    ]
    return rows


@pytest.mark.parametrize("leaf_rows", [1024, 20])
def test_links_equal_all_pairs(spark, leaf_rows):
    rows = vectors()
    frame = spark.createDataFrame([r + ("x", "y") for r in rows], "vec_id long, embedding array<float>, label int, vertex string, node string")
    got = near_vectors(frame, 0.93, leaf_rows).select("vec_id", "n_links", "component_id", "kept").collect()
    want = [(a, b, c, True if a is None and c is None else d) for a, b, c, d in brute(rows, 0.93)]
    assert by_key(got) == by_key(want)


def test_links_in_other_ways(spark, monkeypatch):
    # centres too many for every task, trees that are grown again, and vectors whose marks are equal
    monkeypatch.setattr(covertree, "CENTRE_BYTES", 0)
    monkeypatch.setattr(covertree, "TREE_BYTES", 1)
    monkeypatch.setattr(covertree, "_marks", lambda: {"mark_a": F.lit(0), "mark_b": F.lit(1)})
    test_links_equal_all_pairs(spark, 20)


def test_blocks_are_not_shuffled_with_their_pairs(spark):
    rows = [(i, 1, [float(i % 7), 1.0, float(i)], ("a", "b/c")[i % 2]) for i in range(90)]
    links = vector_links(spark.createDataFrame(rows, "vertex long, copies long, vector array<double>, tree string"), 0.93, 20)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert links.where("kind = 1").count() > 0


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_doubles_are_compared_as_doubles(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.3).tolist(), 1) for i in range(60)]
    # beyond the range of floats, apart only in digits that floats lack
    rows += [(100, [1e200, 1.0], 2), (101, [1e200, 2.0], 2), (102, [1e-200, 0.0], 2), (103, [-1e300, 0.0], 2)]
    rows += [(200, [0.93, math.sqrt(1 - 0.93**2)], 3), (201, [1.0, 0.0], 3), (202, [0.93 - 1e-12, math.sqrt(1 - (0.93 - 1e-12) ** 2)], 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = near_vectors(frame, 0.93).collect()
    assert by_key(got) == by_key(brute(rows, 0.93, np.float64))
    assert {r.vec_id: r.n_links for r in got if r.vec_id in (100, 103)} == {100: 2, 103: 0}
