import pytest

from tidemark.operators import checklist as K


@pytest.fixture
def items(frame):
    return frame(
        [(1, "I1", "data quality", "d1", 2), (2, "I2", "null checks", "d1", 5), (3, "I3", "spark tests", "d2", 5), (4, "I4", "reports", "d2", 1)],
        "item_id int, code string, title string, dimension string, priority_weight int",
    )


@pytest.fixture
def latest(frame):
    marks = frame(
        [(1, 1, "DONE", 1), (1, 1, "NOT_DONE", 2), (1, 2, "NOT_DONE", 1), (1, 2, "DONE", 3), (1, 99, "DONE", 1), (2, 4, "NOT_DONE", 1)],
        "run_id int, item_id int, status string, ts int",
    )
    return K.latest_marks(marks, ["ts"])


def test_later_marks_win(latest):
    rows = {(r["run_id"], r["item_id"]): r["status"] for r in latest.collect()}
    assert rows[(1, 1)] == "NOT_DONE" and rows[(1, 2)] == "DONE"


def test_coverage_counts_unknown_items(latest, items):
    rows = {r["run_id"]: r["coverage"] for r in K.coverage(latest, items).collect()}
    assert rows == {1: 50.0, 2: 0.0}


def test_dimensions(latest, items):
    rows = {(r["run_id"], r["dimension"]): r["coverage"] for r in K.coverage_by_dimension(latest, items).collect()}
    assert rows == {(1, "d1"): 50.0, (1, "d2"): 0.0, (2, "d1"): 0.0, (2, "d2"): 0.0}


def test_missing(latest, items):
    rows = K.missing_items(latest, items).orderBy("run_id", "place").collect()
    assert [r["item_id"] for r in rows if r["run_id"] == 1] == [3, 1, 4]
    assert [r["item_id"] for r in rows if r["run_id"] == 2] == [2, 3, 1, 4]


def test_large_templates_are_met_in_blocks(latest, items, monkeypatch):
    whole = sorted(map(tuple, K.missing_items(latest, items).collect()))
    monkeypatch.setattr(K, "BLOCK", 1)
    assert sorted(map(tuple, K.missing_items(latest, items).collect())) == whole


def test_recommendations(frame, latest, items):
    docs = frame([(1, "spark.md", "spark tests are good"), (2, "null.md", "null checks matter"), (3, "x.md", "other words")], "doc_id int, filename string, text string")
    rows = {r["run_id"]: r for r in K.recommendations(latest, items, docs).collect()}
    assert rows[1]["missing_codes"] == ["I3", "I1", "I4"] and rows[1]["sources"][0] == "spark.md"
    assert set(rows[2]["sources"][:2]) == {"spark.md", "null.md"}


def test_heaviest_missing_is_the_head_of_all_missing(spark):
    import random

    rng = random.Random(3)
    items = spark.createDataFrame([(i, f"d{i % 3}", rng.randrange(4)) for i in range(40)], "item_id long, dimension string, priority_weight int")
    marks = [(run, rng.randrange(45), rng.choice(["DONE", "NOT_DONE"])) for run in range(12) for _ in range(run * 6 + 1)]
    marks += [(99, i, "DONE") for i in range(40)]
    latest = spark.createDataFrame(sorted(set((r, i) for r, i, _ in marks)), "run_id long, item_id long").join(
        spark.createDataFrame(marks, "run_id long, item_id long, status string").dropDuplicates(["run_id", "item_id"]), ["run_id", "item_id"])
    latest = spark.createDataFrame(latest.collect(), latest.schema)
    head = K.missing_items(latest, items).filter("place <= 5")
    assert sorted(map(tuple, K.heaviest_missing(latest, items).collect())) == sorted(map(tuple, head.collect()))
