import math
import random
from fractions import Fraction

import numpy as np

from tidemark.llm import queries
from tidemark.llm.whitening import fit, usable, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, deviation long, k int, vector string"
CLASH = (1, 2, 3, 4, "x")


def embeddings(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v) + CLASH for i, v in rows], schema)


def integers(vectors):
    return [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]


def exact(vectors):
    """n, sums and the covariance, entry by entry in whole numbers."""
    x = integers(vectors)
    n, size = len(x), len(x[0])
    sums = [sum(row[i] for row in x) for i in range(size)]
    far = [[n * v - s for v, s in zip(row, sums)] for row in x]
    covariance = [[Fraction(sum(row[i] * row[j] for row in far), n**3) for j in range(size)] for i in range(size)]
    return x, n, sums, far, covariance


def sample(n=90, size=12, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, size)) @ np.diag(np.linspace(0.2, 1.5, size))).astype(np.float32).tolist()


def check(rows, vectors_by_id, components=8):
    vectors = list(vectors_by_id.values())
    x, n, sums, far, covariance = exact(vectors)
    matrix = np.array([[float(c) for c in row] for row in covariance])
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(sum(covariance[i][i] for i in range(len(sums))))
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == vectors_by_id.keys()
    sign = {}
    for k, vec_id in enumerate(vectors_by_id):
        assert set(got[vec_id]) == set(range(1, min(components, len(sums)) + 1))
        for c, r in got[vec_id].items():
            assert r.n == n and r.deviation == sum(d * d for d in far[k])
            expected = sum(float(Fraction(d, n)) * axes[i, c - 1] for i, d in enumerate(far[k])) / math.sqrt(values[c - 1])
            if abs(expected) > 1e-3:
                assert sign.setdefault(c, math.copysign(1, r.whitened * expected)) == math.copysign(1, r.whitened * expected)
            assert math.isclose(abs(r.whitened), abs(expected), rel_tol=1e-7, abs_tol=1e-9)
            assert math.isclose(r.explained, values[c - 1] / trace, rel_tol=1e-9) and r.identity_error < 1e-9


def test_whitened_equals_exact_arithmetic(spark, tmp_path):
    good = dict(enumerate(sample()))
    bad = [(500, None), (501, [None] + [1.0] * 11), (502, [float("nan")] * 12), (503, [float("inf")] + [0.0] * 11), (504, []), (505, [1.0, 2.0])]
    embeddings(spark, [*good.items(), *bad]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), good)


def test_covariance_is_the_exact_one_rounded_once(spark):
    vectors = sample(200, 5, seed=3)
    model = fit(usable(embeddings(spark, enumerate(vectors))))
    _, n, sums, _, covariance = exact(vectors)
    assert model.n == n and model.sums == sums
    assert model.covariance.tolist() == [[float(c) for c in row] for row in covariance]


def test_large_entries_stay_exact(spark):
    rng = random.Random(5)
    vectors = [[rng.choice([-1, 1]) * 10.0 ** rng.randrange(0, 14) * rng.random() for _ in range(3)] for _ in range(40)]
    df = embeddings(spark, enumerate(vectors), SCHEMA.replace("array<float>", "array<double>"))
    model = fit(usable(df))
    _, n, sums, far, covariance = exact(vectors)
    assert model.sums == sums and model.covariance.tolist() == [[float(c) for c in row] for row in covariance]
    deviations = {r.vec_id: r.deviation for r in whiten(df).collect()}
    squares = [sum(d * d for d in row) for row in far]
    assert deviations == {k: d if d < 2**63 else None for k, d in enumerate(squares)}
    small = {r.vec_id: r.deviation for r in whiten(embeddings(spark, [(1, [3e15]), (2, [3e15 + 2**30])])).collect()}
    assert small == {1: None, 2: None}


def test_repeated_ids_short_vectors_and_no_variance(spark):
    rows = whiten(embeddings(spark, [(1, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [0.5, 0.6]), (2, [0.5, 0.6])])).collect()
    assert len(rows) == 8 and {r.component for r in rows} == {1, 2} and sum(r.vec_id is None for r in rows) == 2
    flat = whiten(embeddings(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0])])).collect()
    assert {(r.vec_id, r.component, r.explained): r.whitened is None for r in flat} == {(1, 1, 1.0): False, (2, 1, 1.0): False, (1, 2, 0.0): True, (2, 2, 0.0): True}
    assert {r.identity_error < 1e-12 for r in flat} == {True}
    one = whiten(embeddings(spark, [(1, [1.0, 5.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2


def test_empty_tables(spark):
    assert whiten(embeddings(spark, [])).collect() == []
    assert whiten(embeddings(spark, [(1, None), (2, [])])).collect() == []
