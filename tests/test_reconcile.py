import pytest

from tidemark.operators.reconcile import Options, composite_key, diff_top_n, flat_diffs, reconcile


def run(gold, target, keys, values, **options):
    options.setdefault("duplicate_policy", "mean")
    return reconcile(gold, target, keys, values, Options(**options))


@pytest.fixture
def gold(frame):
    return frame([("A", 10.0), ("B", 20.0), ("C", 30.0)], "Produto string, `Preço Unitário` double")


def test_one_mismatch(frame, gold):
    target = frame([("a ", 10.0), ("b", 25.0), ("C!", 30.0)], "produto string, preco_unitario double")
    result = run(gold, target, ["Produto"], ["Preço Unitário"])
    summary = result.summary.first()
    assert (summary["mismatches_total"], summary["accuracy"], summary["common_keys"]) == (1, round(2 / 3, 4), 3)
    diff = flat_diffs(result.diffs).first()
    assert (diff["produto"], diff["gold"], diff["target"], diff["corrected"], diff["delta"]) == ("b", 20.0, 25.0, 20.0, 5.0)
    corrected = {r["produto"]: r["preco_unitario"] for r in result.corrected.collect()}
    assert corrected == {"a ": 10.0, "b": 20.0, "C!": 30.0}


def test_corrected_target_agrees_with_gold(frame, gold):
    target = frame([("A", 1.0), ("B", None), ("C", 3.0)], "produto string, preco_unitario double")
    corrected = run(gold, target, ["produto"], ["preco_unitario"]).corrected
    assert run(gold, corrected, ["produto"], ["preco_unitario"]).summary.first()["mismatches_total"] == 0


def test_gold_duplicates_are_refused(frame):
    gold = frame([("A", 1.0), ("a", 2.0), ("B", 3.0)], "k string, v double")
    with pytest.raises(ValueError, match=r"Duplicate keys found in GOLD dataset: \['a'\]... \(1 total\)"):
        run(gold, gold, ["k"], ["v"], check_gold="eager")
    with pytest.raises(Exception, match="Duplicate keys found in GOLD dataset: a"):
        run(gold, gold, ["k"], ["v"]).summary.collect()


def test_missing_columns_name_the_side(frame, gold):
    target = frame([("A", 1.0)], "produto string, other double")
    with pytest.raises(ValueError, match="TARGET"):
        run(gold, target, ["produto"], ["preco_unitario"])


@pytest.mark.parametrize("policy, value", [("keep_last", 15.0), ("sum", 25.0), ("mean", 12.5), ("unknown", 15.0)])
def test_duplicate_policies(frame, policy, value):
    gold = frame([("A", 15.0), ("B", 20.0)], "k string, v double")
    target = frame([("A", 10.0, 1), ("A", 15.0, 2), ("B", 20.0, 3)], "k string, v double, seq int")
    result = run(gold, target, ["k"], ["v"], duplicate_policy=policy, order_by=["seq"])
    fixed = result.joined.filter("k = 'A'").first()
    assert fixed["v"] == value
    assert result.summary.first()["rows_target"] == 2


def test_keep_last_needs_an_order(frame, gold):
    with pytest.raises(ValueError, match="order_by"):
        run(gold, gold, ["Produto"], ["Preço Unitário"], duplicate_policy="keep_last")


def test_policy_sum_matches_gold(frame):
    gold = frame([("X", 100), ("Y", 200)], "Product string, Amount long")
    target = frame([("X", 50), ("X", 50), ("Y", 200)], "Product string, Amount long")
    assert run(gold, target, ["Product"], ["Amount"], duplicate_policy="sum").summary.first()["accuracy"] == 1.0


def test_tolerance(frame):
    gold = frame([("A", 100.0), ("B", 200.0), ("C", 300.0)], "ID string, Value double")
    target = frame([("A", 100.01), ("B", 200.05), ("C", 300.15)], "ID string, Value double")
    assert run(gold, target, ["ID"], ["Value"], tolerance=0.1).summary.first()["mismatches_total"] == 1


def test_thousand_rows(spark):
    gold = spark.range(1000).selectExpr("id", "id * 10 AS value")
    target = spark.range(1000).selectExpr("id", "id * 10 + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS value")
    result = run(gold, target, ["id"], ["value"])
    assert result.summary.first()["accuracy"] == 0.9
    assert diff_top_n(result.diffs, 7).count() == 7


def test_nulls_infinities_and_european_text(frame):
    gold = frame([("a", "1.234,56"), ("b", None), ("c", "inf"), ("d", "5")], "k string, v string")
    target = frame([("a", "1,234.56"), ("b", "0"), ("c", "inf"), ("d", None)], "k string, v string")
    assert run(gold, target, ["k"], ["v"]).summary.first()["mismatches_total"] == 1
    assert run(gold, target, ["k"], ["v"], null_equals_zero=False).summary.first()["mismatches_total"] == 2
    # without number styles the separators make the text unreadable on both sides
    raw = run(gold, target, ["k"], ["v"], coerce_numeric=False)
    assert raw.summary.first()["mismatches_total"] == 1


def test_extra_and_missing(frame):
    gold = frame([("a", 1.0), ("b", 2.0)], "k string, v double")
    target = frame([("a", 1.0), ("x", 5.0), ("y", 6.0)], "k string, v double")
    result = run(gold, target, ["k"], ["v"])
    row = result.summary.first()
    assert (row["extra_in_target"], row["missing_in_target"]) == (2, 1)
    assert {r["k"]: r["v"] for r in result.corrected.collect()} == {"a": 1.0, "x": 5.0, "y": 6.0}
    nothing = run(gold, target.filter("k = 'x'"), ["k"], ["v"]).summary.first()
    assert nothing["accuracy"] == 0.0


def test_three_keys_keep_their_spelling(frame):
    schema = "Ano int, `Mês` int, UF string, `Imposto Pago` double"
    gold = frame([(2024, 1, "SP", 100.0), (2024, 2, "RJ", 50.0)], schema)
    target = frame([(2024, 1, "sp ", 100.0), (2024, 2, "rj", 70.0)], schema)
    diff = flat_diffs(run(gold, target, ["Ano", "Mês", "UF"], ["Imposto Pago"]).diffs).first()
    assert (diff["ano"], diff["mes"], diff["uf"], diff["corrected"]) == (2024, 2, "rj", 50.0)


def test_separator_does_not_join_distinct_keys(frame):
    gold = frame([("a||", "b", 1.0)], "x string, y string, v double")
    target = frame([("a", "||b", 9.0)], "x string, y string, v double")
    options = dict(strip_punctuation=False)
    assert run(gold, target, ["x", "y"], ["v"], **options).summary.first()["common_keys"] == 0
    assert composite_key(gold, ["x", "y"]).first()["composite_key"] == "a||b"


def test_summary_and_differences_leave_other_columns_unread(spark, tmp_path):
    rows = [(i, float(i), i % 3, f"note {i}") for i in range(50)]
    spark.createDataFrame(rows, "id int, price double, seq int, note string").write.parquet(str(tmp_path / "t"))
    gold = spark.createDataFrame([(i, float(i)) for i in range(40)], "id int, price double")
    result = reconcile(gold, spark.read.parquet(str(tmp_path / "t")), ["id"], ["price"], Options(order_by=["seq"]))
    read = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "note" not in read(result.summary) and "note" not in read(result.diffs) and "note" in read(result.corrected)
