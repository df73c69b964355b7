"""Profiles merged from loads against the exact path."""

import math
import random

from tidemark.operators.profile import profile_columns
from tidemark.operators.sketches import ProfileStore

SCHEMA = "id long, x double, word string, day date, none string"


def loads(spark):
    rng = random.Random(9)
    number = lambda: rng.choice([None, float("nan"), 0.0, -0.0, rng.gauss(50, 20), rng.gauss(50, 20), rng.gauss(50, 20)])
    for k in range(4):
        rows = [(k * 3000 + i, number(), None if i % 9 == 0 else f"word {rng.randrange(800)}", None, None) for i in range(2000 + 700 * k)]
        yield spark.createDataFrame(rows, SCHEMA)


def test_merged_profile_is_near_the_exact_one(spark, tmp_path):
    store, every = ProfileStore(spark, str(tmp_path)), None
    for k, load in enumerate(loads(spark)):
        store.add(load, str(k))
        every = load if every is None else every.unionByName(load)
    # a load that comes again replaces itself
    store.add(load, "3")
    found = {r["column"]: r for r in store.profile().collect()}
    exact = {r["column"]: r for r in profile_columns(every).collect()}
    rows = every.count()
    for name, r in found.items():
        e = exact[name]
        assert r["rows"] == rows and r["null_count"] == e["null_count"] and math.isclose(r["null_ratio"], e["null_ratio"])
        # three standard errors of 2**12 registers
        assert abs(r["unique_count"] - e["unique_count"]) <= 0.05 * e["unique_count"]
        for figure in ("min", "max", "mean", "std"):
            if name in ("id", "x"):
                assert math.isclose(r[figure], float(e[figure]), rel_tol=1e-9), (name, figure)
        for figure in ("avg_length", "max_length"):
            assert (r[figure] is None) == (e[figure] is None) and (r[figure] is None or math.isclose(r[figure], e[figure]))
    for name in ("id", "x"):
        values = sorted(v[0] for v in every.select(name).collect() if v[0] is not None and not math.isnan(v[0]))
        low, high = sum(v < found[name]["median"] for v in values), sum(v <= found[name]["median"] for v in values)
        assert low / len(values) <= 0.53 and high / len(values) >= 0.47
    assert found["none"]["unique_count"] == 0 and found["none"]["median"] is None and found["day"]["null_count"] == rows


def test_a_profile_reads_no_load(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "profiles"))
    spark.range(5000).write.parquet(str(tmp_path / "table"))
    store.add(spark.read.parquet(str(tmp_path / "table")), "a")
    store.add(spark.range(5000, 6000), "b")
    merged = store.profile()
    read = merged.inputFiles()
    assert len(read) == 2 and all("/profiles/load=" in f for f in read)
    row = merged.first()
    assert (row["rows"], row["min"], row["max"]) == (6000, 0.0, 5999.0) and abs(row["unique_count"] - 6000) < 300


def test_empty_load(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path))
    store.add(spark.createDataFrame([], SCHEMA), "a")
    assert {(r["rows"], r["unique_count"], r["mean"], r["std"]) for r in store.profile().collect()} == {(0, 0, None, None)}
