import datetime as dt

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators import cleaning as C
from tidemark.operators.schema import schema_conformance


def test_clean_frame(frame):
    df = frame(
        [("  a ", "1,5", "2024-01-01", None, "x"), ("", "2.000,25", "2024-01-02", None, "7"), (None, "3", "oops", None, "8"), ("b\x00", " 4 ", "2024-01-04", None, "9")],
        "`Col One` string, Amount string, Day string, `Empty Column` string, Mixed string",
    )
    result = C.clean_dataset(df)
    assert result.data.columns == ["col_one", "amount", "day", "mixed"]
    assert result.plan == C.Plan(["empty_column"], ["amount"], ["day"])
    rows = result.data.collect()
    assert [r["col_one"] for r in rows] == ["a", None, None, "b"]
    assert [r["amount"] for r in rows] == [1.5, 2000.25, 3.0, 4.0]
    assert [r["day"] for r in rows] == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), None, dt.datetime(2024, 1, 4)]
    assert [r["mixed"] for r in rows] == ["x", "7", "8", "9"]
    report = {r["column"]: r for r in result.report.collect()}
    assert report["col_one"]["nulls_before"] == 1 and report["col_one"]["nulls_after"] == 2
    assert report["col_one"]["trimmed"] == 3
    assert report["amount"]["made_numeric"] == 2
    assert report["day"]["parsed_dates"] == 3 and report["day"]["unparsed_dates"] == 1
    assert report["empty_column"]["removed"]


def test_unparsed_text_can_be_kept(frame):
    df = frame([("2024-01-01",), ("2024-01-02",), ("soon",)], "day string")
    rows = C.clean_dataset(df, C.CleanOptions(keep_unparsed=True)).data.collect()
    assert [r["day__unparsed"] for r in rows] == [None, None, "soon"]


def test_half_of_the_dates_is_not_enough(frame):
    df = frame([("2024-01-01",), ("soon",)], "day string")
    assert C.clean_dataset(df).plan.dates == []


def test_steps_can_be_switched_off(frame):
    df = frame([(" 1,5 ", None), (" 1,5 ", None)], "`A B` string, gone string")
    options = C.CleanOptions(normalize_headers=False, drop_empty_columns=False, trim_strings=False, coerce_numeric=False, parse_dates=False)
    assert C.clean_dataset(df, options).data.collect() == df.collect()
    assert C.clean_dataset(df, C.CleanOptions(drop_duplicates=True)).data.count() == 1


def test_empty_input_has_no_decisions(frame):
    df = frame([], "a string, b int")
    assert C.clean_dataset(df, C.CleanOptions(drop_empty_columns=False)).data.count() == 0


def test_nan_counts_as_empty(frame):
    df = frame([(float("nan"), 1), (None, 2)], "x double, y int")
    assert C.empty_columns(df) == ["x"]
    assert C.drop_empty_columns(df).columns == ["y"]


def test_conformance(frame):
    df = frame([("1", 1), ("x", 2), (None, 3)], "a string, b int")
    rows = {r["column"]: r for r in schema_conformance(df, {"a": "integer", "b": "integer", "c": "date"}).collect()}
    assert (rows["a"]["status"], rows["a"]["bad_values"]) == ("type_differs", 1)
    assert rows["b"]["status"] == "ok" and rows["c"]["status"] == "missing"


def test_report_and_rows_come_from_one_pass(spark, frame, tmp_path):
    rows = [("  a ", "1,5", "2024-01-01", None, "x", 1.5), ("", "2.000,25", "2024-01-02", None, "7", float("nan")), (None, "3", "oops", None, "8", None), ("  a ", "1,5", "2024-01-01", None, "x", 1.5)]
    df = frame(rows, "`Col One` string, Amount string, Day string, `Empty Column` string, Mixed string, Number double")
    source = str(tmp_path / "source")
    df.write.parquet(source)
    for options in (C.CleanOptions(), C.CleanOptions(drop_duplicates=True, keep_unparsed=True)):
        written = C.write_clean(spark.read.parquet(source), str(tmp_path / f"out{options.drop_duplicates}"), options)
        found = written.report.collect(), written.totals.collect()
        apart = C.clean_dataset(spark.read.parquet(source), options)
        assert sorted(map(tuple, found[0])) == sorted(map(tuple, apart.report.collect())) and found[1] == apart.totals.collect()
        assert sorted(map(str, written.data.collect())) == sorted(map(str, apart.data.collect()))
    # the rows are counted on their way to the files: one scan below both counters
    plan = C.decide(spark.read.parquet(source))
    staged = C._staged(spark.read.parquet(source), C.CleanOptions(), plan.numeric, plan.dates)
    shown = C._chosen(staged.observe(Observation(), F.count(F.lit(1)).alias("rows")), spark.read.parquet(source), plan, C.CleanOptions())
    text = shown._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "CollectMetrics" in text
