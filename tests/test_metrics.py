import random
import statistics

import pytest

from tidemark.operators import metrics as M
from tidemark.operators import profile as P
from tidemark.operators.median import exact_medians
from tidemark.plans.quality import QualityReport


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_completeness(frame):
    df = frame(
        [(1.0, "a", None), (2.0, None, None), (float("nan"), "c", None), (4.0, "d", None)],
        "col1 double, col2 string, col3 string",
    )
    # 12 cells, 6 missing counting NaN
    facts = M.column_facts(df)
    overall = M.completeness_overall(facts).first()
    assert (overall["total_cells"], overall["missing_cells"], overall["overall_completeness"]) == (12, 6, 50.0)
    assert by_column(M.completeness_columns(facts))["col1"]["completeness"] == 75.0


def test_completeness_five_of_twelve(frame):
    df = frame([(1.0, "a", None), (2.0, None, None), (3.0, "c", None), (4.0, "d", None)], "a double, b string, c string")
    assert M.completeness_overall(M.column_facts(df)).first()["overall_completeness"] == 58.33


def test_row_uniqueness(frame):
    df = frame([(1, "a"), (2, "b"), (3, "c"), (1, "a"), (5, "e")], "id long, name string")
    row = M.row_uniqueness(df).first()
    assert (row["overall_uniqueness"], row["duplicate_rows"]) == (80.0, 1)


def test_wide_rows_give_the_same(frame):
    rows = [(1.0, "a"), (0.0, "z"), (-0.0, "z"), (float("nan"), None), (float("nan"), None), (1.0, "a"), (1.0, "b"), (None, None)]
    df = frame(rows, "x double, s string")
    assert M.row_uniqueness_wide(df).first() == M.row_uniqueness(df).first()
    # (NaN, NULL) and (NULL, NULL) are the same row
    assert M.row_uniqueness(df).first()["unique_rows"] == 4
    assert M.row_uniqueness_wide(df.limit(0)).first()["total_rows"] == 0


def test_column_uniqueness(frame):
    df = frame([(1.0, "a"), (0.0, "a"), (-0.0, None), (float("nan"), "b")], "x double, y string")
    exact = by_column(M.column_uniqueness(df))
    assert (exact["x"]["unique_count"], exact["x"]["total_count"]) == (2, 3)
    assert (exact["y"]["unique_count"], exact["y"]["total_count"]) == (2, 3)
    near = by_column(M.column_uniqueness(df, approximate=True))
    assert near["y"]["unique_count"] == 2


def test_validity(frame):
    df = frame(
        [(1.0, "valid"), (2.0, ""), (3.0, "also valid"), (float("inf"), "  ")], "numbers double, strings string"
    )
    rows = by_column(M.validity_columns(M.column_facts(df)))
    assert rows["numbers"]["validity"] == 75.0 and rows["strings"]["validity"] == 50.0


def test_consistency(frame):
    df = frame([(1, "a", None), (2, "bbbbbbbb", None), (3, "cc", None)], "n long, s string, empty string")
    rows = by_column(M.consistency_columns(M.column_facts(df)))
    lengths = [1, 8, 2]
    expected = round(100 - 10 * statistics.stdev(lengths) / statistics.mean(lengths), 2)
    assert rows["n"]["consistency"] == 100.0 and rows["s"]["consistency"] == expected
    assert "empty" not in rows
    one = frame([("abc",)], "s string")
    assert M.consistency_overall(M.column_facts(one)).first()[0] == 100.0


@pytest.mark.parametrize("value, text", [(88.25, "88.2"), (88.75, "88.8"), (88.35, "88.3"), (0.0, "0.0"), (12.05, "12.1"), (66.67, "66.7"), (99.99, "100.0")])
def test_percent_text_rounds_like_the_binary_value(spark, value, text):
    assert text == f"{value:.1f}"
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(M._one_decimal(df.v)).first()[0] == text


def test_report(frame):
    df = frame([("a", None), ("a", None), (None, 1.0), ("   ", None)], "s string, x double")
    report = QualityReport(df)
    score = report.score.first()
    assert 0 <= score["overall_quality_score"] <= 100
    advice = {r["category"]: r for r in report.recommendations.collect()}
    assert advice["completeness"]["severity"] == "high" and "x, s" in advice["completeness"]["message"]
    assert advice["uniqueness"]["message"].startswith("Found 1 duplicate rows")
    assert {r["data_type"]: r["columns"] for r in report.data_types.collect()} == {"text": 1, "float": 1}


@pytest.mark.parametrize("shape", ["uniform", "ties", "outliers", "even", "single"])
def test_bracketed_median_is_exact(spark, shape):
    rng = random.Random(5)
    n = {"even": 2000, "single": 1}.get(shape, 2001)
    values = {
        "uniform": lambda: rng.random(),
        "even": lambda: rng.random(),
        "single": lambda: 3.0,
        "ties": lambda: float(rng.choice([1, 1, 1, 2, 50])),
        "outliers": lambda: rng.choice([1e-9, 1e18, rng.random()]),
    }[shape]
    data = [values() for _ in range(n)]
    rows = [(v, None if i % 3 else v, None) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "a double, b double, empty double").repartition(5)
    found = {r["column"]: r["median"] for r in exact_medians(df, ["a", "b", "empty"], partitions=1 if n == 1 else 7).collect()}
    assert found["a"] == statistics.median(data)
    assert found["b"] == statistics.median([v for i, v in enumerate(data) if i % 3 == 0])
    assert found["empty"] is None


def test_profile(frame):
    df = frame([(1, "a", 1.5), (2, "b", None), (3, "a", 2.5), (4, "ccc", 3.5), (5, "a", 4.5)], "id long, name string, score double")
    rows = by_column(P.profile_columns(df))
    assert rows["score"]["null_ratio"] == 0.2 and rows["score"]["unique_ratio"] == 0.8
    assert (rows["id"]["min"], rows["id"]["max"], rows["id"]["median"]) == (1.0, 5.0, 3.0)
    assert rows["name"]["max_length"] == 3 and rows["name"]["type"] == "string"
    top = P.top_values(df, k=2).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [("a", 3), ("b", 1)]
    with pytest.raises(ValueError):
        P.inspect_dataset(df.limit(0), "csv")
    numbers = df.select("id", "score")
    assert P.top_values(numbers).count() == 0
    assert P.inspect_dataset(numbers, "csv", delimiter=";").first()["detected_options"] == "delimiter=;"


def test_sample_does_not_depend_on_layout(spark):
    ids = spark.range(1000)
    one = {r[0] for r in P.sample_rows(ids.repartition(7), 50, ["id"]).collect()}
    two = {r[0] for r in P.sample_rows(ids.coalesce(1), 50, ["id"]).collect()}
    assert one == two and len(one) == 50


def test_booleans_have_statistics_and_schema_edits_apply(frame):
    df = frame([(True, 1), (False, None), (True, 3)], "flag boolean, n int")
    profile = P.profile_columns(df)
    flag = by_column(profile)["flag"]
    assert (flag["min"], flag["max"], flag["median"], round(flag["mean"], 4)) == (0.0, 1.0, 1.0, 0.6667)
    schema = {r["name"]: (r["type"], r["nullable"]) for r in P.suggest_schema(profile, {"columns": {"n": {"type": "long"}}}).collect()}
    assert schema == {"flag": ("boolean", False), "n": ("long", True)}
