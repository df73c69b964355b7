import random

import pytest

from tidemark.operators import synth as S
from tidemark.operators import unique
from tidemark.operators.unique import enforce_unique

SPEC = [
    {"name": "n", "type": "integer", "options": {"min": 5, "max": 9}},
    {"name": "p", "type": "price", "options": {"min": 1, "max": 2}},
    {"name": "b", "type": "boolean"},
    {"name": "d", "type": "date", "options": {"start": "2024-01-01", "end": "2024-01-31"}},
    {"name": "t", "type": "datetime", "options": {"start": "2024-01-01", "end": "2024-01-31"}},
    {"name": "c", "type": "category", "options": {"categories": {"x": 9, "y": 1}}},
    {"name": "k", "type": "custom_pattern", "options": {"pattern": "AB-##"}},
    {"name": "s", "type": "string", "options": {"length": 8, "allow_nulls": 30}},
]


def test_ranges_and_shapes(spark):
    rows = S.generate(spark, SPEC, 500, seed=1).collect()
    assert len(rows) == 500
    assert {r["n"] for r in rows} == {5, 6, 7, 8, 9}
    assert all(1 <= r["p"] <= 2 and round(r["p"], 2) == r["p"] for r in rows)
    assert {r["b"] for r in rows} == {True, False}
    assert all("2024-01-01" <= r["d"] <= "2024-01-31" and len(r["t"]) == 19 for r in rows)
    assert sum(r["c"] == "x" for r in rows) > 400
    assert all(r["k"][:3] == "AB-" and r["k"][3:].isdigit() for r in rows)
    assert 0.2 < sum(r["s"] is None for r in rows) / 500 < 0.4
    assert all(len(r["s"]) == 8 for r in rows if r["s"])


def test_seed_decides_not_the_layout(spark):
    ids = spark.range(100)
    one = sorted(S.synthesize(ids.repartition(7), SPEC, seed=3).collect(), key=str)
    two = sorted(S.synthesize(ids.coalesce(1), SPEC, seed=3).collect(), key=str)
    other = sorted(S.synthesize(ids, SPEC, seed=4).collect(), key=str)
    assert one == two != other


def test_unique_columns(spark):
    spec = [
        {"name": "i", "type": "integer", "options": {"min": 1, "max": 300, "unique": True}},
        {"name": "d", "type": "date", "options": {"start": "2024-01-01", "end": "2024-12-31", "unique": True}},
        {"name": "e", "type": "email", "options": {"unique": True}},
        {"name": "f", "type": "float", "options": {"min": 0, "max": 3, "unique": True}},
    ]
    rows = S.generate(spark, spec, 300).collect()
    for name in "idef":
        assert len({r[name] for r in rows}) == 300
    with pytest.raises(ValueError, match="only 300 exist"):
        S.generate(spark, spec, 301)


@pytest.mark.parametrize(
    "spec, message",
    [
        ([], "At least one column"),
        ([{"name": "a", "type": "integer"}, {"name": "a", "type": "uuid"}], "Duplicate"),
        ([{"name": "a", "type": "blob"}], "unsupported type"),
        ([{"name": "a", "type": "integer", "options": {"min": 5, "max": 5}}], "min must be less"),
        ([{"name": "a", "type": "price", "options": {"min": "x", "max": 5}}], "must be numeric"),
        ([{"name": "a", "type": "date"}], "start and end"),
        ([{"name": "a", "type": "category"}], "categories"),
        ([{"type": "integer"}], "no valid name"),
    ],
)
def test_bad_specs(spark, spec, message):
    with pytest.raises(ValueError, match=message):
        S.generate(spark, spec, 5)


def test_the_caller_limits_columns():
    spec = [{"name": f"c{i}", "type": "integer"} for i in range(51)]
    assert S.validate_spec(spec) == [] and S.validate_spec(spec, max_columns=51) == []
    assert S.validate_spec(spec, max_columns=50) == ["at most 50 columns are allowed, the spec has 51"]


def test_row_limits(spark):
    with pytest.raises(ValueError, match="at least 1"):
        S.generate(spark, SPEC, 0)
    with pytest.raises(ValueError, match="must not exceed 100"):
        S.preview(spark, SPEC, 101)
    assert S.preview(spark, SPEC, 100).count() == 100


def greedy(rows, columns):
    seen, kept = [set() for _ in columns], []
    for row in sorted(rows):
        values = row[1:]
        if any(v is not None and v in s for v, s in zip(values, seen)):
            continue
        kept.append(row[0])
        for v, s in zip(values, seen):
            if v is not None:
                s.add(v)
    return kept


@pytest.mark.parametrize("seed, hot", [(1, False), (2, False), (3, True)])
def test_unique_like_the_sequential_loop(spark, seed, hot):
    rng = random.Random(seed)
    pick = lambda n: None if rng.random() < 0.1 else (0 if hot and rng.random() < 0.4 else rng.randrange(n))
    rows = [(i, pick(40), pick(30), pick(60)) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq int, a int, b int, c int")
    assert sorted(r["seq"] for r in enforce_unique(df, ["a", "b", "c"], "seq").collect()) == greedy(rows, "abc")
    one = [(r[0], r[1]) for r in rows]
    assert sorted(r["seq"] for r in enforce_unique(df.select("seq", "a"), ["a"], "seq").collect()) == greedy(one, "a")


def test_unique_of_nothing(spark):
    df = spark.createDataFrame([], "seq int, a int, b int")
    assert enforce_unique(df, ["a", "b"], "seq").count() == 0


def chains(n, rng):
    """Rows that each share a value with the next one of their chain, which no round over all rows settles quickly."""
    rows = []
    for c, length in enumerate((n, 300, 40, 40, 1, 1)):
        rows += [(f"{c}:{i // 2}", f"{c}:{(i + 1) // 2}", None if i % 5 else 0.0 - c) for i in range(length)]
    return [(i, *r) for i, r in enumerate(rows)]


def test_a_long_chain_takes_a_handful_of_rounds(spark, monkeypatch):
    rows = chains(10_000, random.Random(1))
    df = spark.createDataFrame(rows, "seq long, a string, b string, c double").repartition(4)
    rounds = []
    first = unique._first_of_all
    monkeypatch.setattr(unique, "_first_of_all", lambda *a: rounds.append(1) or first(*a))
    assert sorted(r["seq"] for r in enforce_unique(df, ["a", "b", "c"], "seq").collect()) == greedy(rows, "abc")
    assert len(rounds) == unique.ROUNDS


def test_components_and_first_rows_equal_the_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(unique, "TASK_ROWS", 350)
    rows = chains(450, random.Random(2))
    df = spark.createDataFrame(rows, "seq long, a string, b string, c double")
    assert sorted(r["seq"] for r in enforce_unique(df, ["a", "b"], "seq").collect()) == greedy([r[:3] for r in rows], "ab")


def test_components(spark):
    rows = [(1, "x", None), (2, "y", "p"), (3, "x", "q"), (4, "z", "q"), (5, None, None), (6, "w", "p"), (7, "w", "r"), (8, "v", "r")]
    df = spark.createDataFrame(rows, "seq long, v0 string, v1 string")
    assert {r["seq"]: r["label"] for r in unique._components(df, ["v0", "v1"]).collect()} == {1: 1, 3: 1, 4: 1, 2: 2, 6: 2, 7: 2, 8: 2, 5: 5}


def test_unique_values_are_counted_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    from registry import synth as R

    spark.range(3_000).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(R, "TASK_ROWS", 500)
    made = R.synth_unique(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "REPARTITION_BY_NUM" in plan and ", 6)" in plan
    assert [tuple(r) for r in made.collect()] == [(3_000, 3_000, 3_000, True)]
