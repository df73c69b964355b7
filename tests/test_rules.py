import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile as P
from tidemark.operators import rules as R


def summary(df, rules, **kw):
    return {r["rule"]: r for r in R.rules_summary(df, rules, **kw).collect()}


@pytest.fixture
def people(frame):
    return frame(
        [
            (1, "a@b.com", 30.0, "2024-01-02", "BR", "x"),
            (2, None, -1.0, "2024-13-02", "US", "y"),
            (2, "bad", float("nan"), None, "ZZ", None),
            (None, "c@d.org", 200.0, "02/01/2024", None, "x"),
            (None, "e@f.org", None, "2024-02-30", "BR", "x"),
        ],
        "id int, email string, age double, day string, country string, grp string",
    )


def test_every_rule_type(people):
    found = summary(
        people,
        [
            {"type": "not_null", "column": "email"},
            {"type": "not_null", "column": "age"},
            {"type": "uniqueness", "columns": ["id"]},
            {"type": "format", "column": "day", "format": "yyyy-mm-dd"},
            {"type": "format", "column": "day", "format": "^2024"},
            {"type": "range", "column": "age", "min": 0, "max": 120},
            {"type": "in_set", "column": "country", "values": ["BR", "US"]},
            {"type": "regex", "column": "email", "pattern": "@"},
            {"type": "cross_column_comparison", "column1": "country", "operator": "!=", "column2": "grp"},
            {"type": "value_distribution", "column": "grp", "value": "x", "min_freq": 0.5, "max_freq": 0.7},
            {"type": "value_distribution", "column": "grp", "value": "y", "min_freq": 0.5, "max_freq": 0.7},
        ],
    )
    count = {k: v["failed_count"] for k, v in found.items()}
    assert count["null_email"] == 1
    assert count["null_age"] == 1  # NaN is a value here
    assert count["uniqueness_id"] == 2 and found["uniqueness_id"]["duplicate_rows"] == 4  # NULLs are a group
    assert count["date_format_day"] == 3
    assert count["format_day"] == 1
    assert count["range_age"] == 3  # -1, 200, and NaN, which is above any bound
    assert count["in_set_country"] == 1
    assert count["regex_email"] == 1
    assert count["cross_column_country_!=_grp"] == 0
    assert found["distribution_grp_x"]["frequency"] == 0.6 and found["distribution_grp_x"]["status"] == "PASSED"
    assert found["distribution_grp_y"]["status"] == "FAILED"


def test_null_is_not_flagged(people):
    rules = [
        {"type": "range", "column": "age", "max": 10},
        {"type": "in_set", "column": "country", "values": ["nothing"]},
        {"type": "regex", "column": "email", "pattern": "nothing"},
    ]
    broken = R.with_violations(people, rules).select("violations").collect()
    assert broken[4][0] == ["in_set_country", "regex_email"]
    assert broken[3][0] == ["range_age", "regex_email"]


def test_missing_columns_and_idle_rules(people):
    found = summary(
        people,
        [
            {"type": "not_null", "column": "nope"},
            {"type": "uniqueness", "columns": ["id", "nope"]},
            {"type": "range", "column": "age"},
            {"type": "regex", "column": "email", "pattern": ""},
            {"type": "uniqueness", "columns": []},
        ],
    )
    assert {k: v["status"] for k, v in found.items()} == {"null_nope": "SKIPPED", "uniqueness_id_nope": "SKIPPED"}


def test_empty_table_distribution_warns(people):
    rule = {"type": "value_distribution", "column": "grp", "value": "x", "min_freq": 0, "max_freq": 1}
    assert summary(people.limit(0), [rule])["distribution_grp_x"]["status"] == "WARNING"


def test_operators(frame):
    df = frame([(1, 2), (2, 2), (3, 2), (None, 2)], "a int, b int")
    expected = {"<": 2, "<=": 1, ">": 2, ">=": 1, "==": 2, "!=": 1}
    for op, failed in expected.items():
        rule = {"type": "cross_column_comparison", "column1": "a", "operator": op, "column2": "b"}
        assert R.failing_rows(df, rule).count() == failed
    with pytest.raises(ValueError):
        R.failing_rows(df, {"type": "cross_column_comparison", "column1": "a", "operator": "~", "column2": "b"})


def test_one_job_reads_the_table_once(people):
    rules = [{"type": "not_null", "column": c} for c in people.columns]
    plan = R.rules_summary(people, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_text_numbers_do_not_raise(frame):
    df = frame([("5",), ("x",), ("500",)], "v string")
    assert R.failing_rows(df, {"type": "range", "column": "v", "max": 100}).count() == 1


def test_samples_and_quarantine(people):
    rules = [{"type": "not_null", "column": "email"}, {"type": "in_set", "column": "country", "values": ["BR"]}]
    samples = R.rule_failure_samples(people, rules, ["country"], per_rule=1)
    assert {(r["rule"], r["country"]) for r in samples.collect()} == {("null_email", "US"), ("in_set_country", "US")}
    valid, bad = R.quarantine_split(people, rules)
    assert valid.count() == 3
    assert sorted(r["reason"] for r in bad.collect()) == ["in_set_country", "in_set_country", "null_email"]


def test_conditional_and_presets(frame):
    df = frame([("purchase", None), ("purchase", 5.0), ("purchase", -1.0), ("view", None), (None, None)], "e string, v double")
    rule = {"type": "conditional", "when": "e = 'purchase'", "then": [
        {"type": "not_null", "column": "v"}, {"type": "range", "column": "v", "min": 0}]}
    assert R.failing_rows(df, rule).count() == 2
    phones = frame([("+1-555-123-4567",), ("5551234567",), ("55-12",), (None,)], "p string")
    assert R.failing_rows(phones, {"type": "preset", "column": "p", "preset": "phone"}).count() == 1


def test_detection_quality(frame):
    expected = frame([(1, "NULL_VALUE"), (2, "NULL_VALUE"), (3, "DUPLICATE")], "row int, problem_type string")
    found = frame([(1, "NULL_VALUE"), (1, "NULL_VALUE"), (9, "NULL_VALUE")], "row int, problem_type string")
    rows = {r["problem_type"]: r for r in R.detection_quality(expected, found, "row").collect()}
    assert (rows["NULL_VALUE"]["precision"], rows["NULL_VALUE"]["recall"]) == (0.5, 0.5)
    assert (rows["DUPLICATE"]["precision"], rows["DUPLICATE"]["recall"]) == (0.0, 0.0)


def test_suggested_rules_run(people):
    profile = P.profile_columns(people.select("id", "age", "country"))
    edits = {"columns": {"country": {"required": True, "allowed_values": ["BR", "US"]}, "age": {"range": {"min": 0}}}}
    rules = P.as_rule_dicts(P.suggest_rules(profile, edits))
    kinds = sorted((r["type"], r.get("column")) for r in rules)
    assert ("in_set", "country") in kinds and ("not_null", "country") in kinds and ("range", "age") in kinds
    assert next(r for r in rules if r["type"] == "range" and r["column"] == "age")["min"] == 0.0
    assert R.rules_summary(people, rules).filter(F.col("status") == "FAILED").count() >= 2


def test_timeliness_of_nothing(frame):
    empty = frame([], "ts timestamp")
    assert R.timeliness(empty, "ts", "2024-01-01 00:00:00", 3).first()["timeliness"] == 0.0


def test_custom_predicate(frame):
    df = frame([(1,), (2,), (None,), (4,)], "v long")
    rule = {"type": "custom", "column": "v", "name": "even", "predicate": lambda values: values % 2 == 0}
    assert [r["v"] for r in R.failing_rows(df, rule).collect()] == [1]
    assert summary(df, [rule])["even"]["failed_count"] == 1


def test_rules_about_the_whole_set_label_rows(frame):
    rows = [(1, 10, "a"), (1, 11, "b"), (2, 12, "3"), (None, 10, "4"), (None, None, "5"), (3, 99, None)]
    df = frame(rows, "id int, ref int, code string")
    rules = [
        {"type": "uniqueness", "columns": ["id"]},
        {"type": "foreign_key", "column": "ref", "reference": "other", "reference_column": "k"},
        {"type": "schema", "column": "code", "dtype": "int"},
        {"type": "range", "column": "ref", "max": 50},
        {"type": "range", "column": "ref", "min": 11},
    ]
    other = {"other": frame([(10,), (11,), (12,)], "k int")}
    found = {(r["id"], r["ref"]): r["v"] for r in R.with_violations(df, rules, "v", other).collect()}
    assert found == {
        (1, 10): ["uniqueness_id", "schema_code", "range_ref_2"], (1, 11): ["uniqueness_id", "schema_code"], (2, 12): [],
        (None, 10): ["uniqueness_id", "range_ref_2"], (None, None): ["uniqueness_id"], (3, 99): ["foreign_key_ref", "range_ref"],
    }
    assert [tuple(r) for r in R.valid_subset(df, rules, references=other).collect()] == [(2, 12, "3")]
    samples = R.rule_failure_samples(df, rules, ["code"], 1, other).collect()
    assert {r["rule"] for r in samples} == {"uniqueness_id", "foreign_key_ref", "schema_code", "range_ref", "range_ref_2"} and len(samples) == 5
    types = {(r["code"], r["problem_type"]) for r in R.detected_problems(df, rules, "code", other).collect()}
    assert ("a", "DUPLICATE") in types and (None, "MISSING_FK") in types and ("b", "WRONG_TYPE") in types and ("a", "OUT_OF_RANGE") in types


def test_a_rule_may_be_called_valid(frame):
    df = frame([(1,), (2,)], "id int")
    valid, bad = R.quarantine_split(df, [{"type": "range", "column": "id", "max": 1, "name": "valid"}])
    assert [r["id"] for r in valid.collect()] == [1] and [(r["id"], r["reason"]) for r in bad.collect()] == [(2, "valid")]


@pytest.mark.parametrize("rule, message", [
    ({"type": "value_distribution", "column": "id", "value": 1, "min_freq": 0, "max_freq": 1}, "cannot label"),
    ({"type": "not_null", "column": "nowhere"}, "not there"),
    ({"type": "foreign_key", "column": "id", "reference": "nowhere", "reference_column": "k"}, "needs the table"),
])
def test_rules_that_label_no_row_are_refused(frame, rule, message):
    df = frame([(1,)], "id int")
    for use in (lambda: R.with_violations(df, [rule]), lambda: R.valid_subset(df, [rule]), lambda: R.rule_failure_samples(df, [rule], ["id"])):
        with pytest.raises(ValueError, match=message):
            use()
    if rule["type"] == "value_distribution":
        with pytest.raises(ValueError, match="no problem type"):
            R.detected_problems(df, [rule], "id")
