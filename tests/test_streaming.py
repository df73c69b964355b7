import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.rules import with_violations
from tidemark.session import scratch_path
from tidemark.streaming import rules as SR
from tidemark.streaming import windows as SW

RULES = [{"type": "range", "column": "value", "min": 0, "max": 10}, {"type": "not_null", "column": "status"}]


@pytest.fixture
def source(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:15:00", float(i % 13), None if i % 7 == 0 else "ok") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, at string, value double, status string").withColumn("at", F.to_timestamp("at"))
    for part in range(3):
        df.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in")


def test_stream_equals_batch_and_is_repeatable(spark, source):
    df, path = source
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        SR.start_rule_stream(stream, RULES, out, state, df.columns).awaitTermination()
    streamed = SR.read_judged(spark, out)
    batch = SR.judged(df, RULES)
    pick = lambda d: sorted((r["id"], r["verdict"], tuple(r["reasons"])) for r in d.collect())
    assert pick(streamed) == pick(batch)
    assert streamed.filter("verdict = 'valid'").count() + streamed.filter("verdict = 'quarantine'").count() == 100


def test_other_shapes_are_refused(spark, source):
    df, path = source
    stream = spark.readStream.schema(df.schema).parquet(path)
    with pytest.raises(ValueError, match="Schema mismatch"):
        SR.start_rule_stream(stream, RULES, "unused", "unused", ["id", "at"])


def test_windows_equal_batch_where_closed(spark, source):
    df, path = source
    repeated = scratch_path(spark, "repeated")
    df.unionByName(df).coalesce(1).write.parquet(repeated)
    build = lambda d: SW.window_metrics(d, "at", "id", "status", "value", F.col("value") > 10, "6 hours", "1 hour")
    metrics = build(spark.readStream.schema(df.schema).parquet(repeated))
    out = scratch_path(spark, "windows")
    SW.start_window_stream(metrics, out, scratch_path(spark, "wstate")).awaitTermination()
    closed = {tuple(r) for r in spark.read.schema(metrics.schema).parquet(out).collect()}
    batch = {tuple(r) for r in build(df).collect()}
    assert closed and closed <= batch
    # the last event is at 23:15, so the windows up to 18:00 are closed
    assert {r[0].hour for r in closed} == {0, 6, 12}


def test_rules_about_the_whole_set_equal_batch_also_after_a_restart(spark, source):
    df, path = source
    known = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    rules = [{"type": "uniqueness", "columns": ["value", "status"]}, *RULES, {"type": "foreign_key", "column": "value", "reference": "known", "reference_column": "v"}]
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    pick = lambda d: sorted((r["id"], r["verdict"], tuple(r["reasons"])) for r in d.collect())
    start = lambda: SR.start_rule_stream(
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), rules, out, state, references={"known": known}
    ).awaitTermination()

    def batch(rows):
        flagged = with_violations(rows, rules, "reasons", {"known": known})
        return pick(flagged.withColumn("verdict", F.when(F.size("reasons") == 0, "valid").otherwise("quarantine")))

    start()
    assert pick(SR.read_judged(spark, out, rules)) == batch(df)
    # more rows after a restart: rows judged before turn with them
    more = spark.createDataFrame([(200, 99.0, "new"), (201, 99.0, "new"), (202, 5.0, None), (203, 5.5, "only")], "id int, value double, status string")
    more = more.withColumn("at", F.to_timestamp(F.lit("2024-01-02 00:00:00"))).select(*df.columns)
    more.coalesce(1).write.mode("append").parquet(path)
    start()
    both = batch(df.unionByName(more))
    assert pick(SR.read_judged(spark, out, rules)) == both and both[-1][1] == "quarantine"


EVENTS = "id int, at string, kind string, value double"


def counted_by_hand(batches, width, lateness):
    """Every row one by one: (counted rows, reasons of the others)."""
    seconds = lambda text: (datetime.fromisoformat(text) - datetime(2024, 1, 1)).total_seconds()
    high, open_keys, counted, aside = None, {}, [], []
    for rows in batches:
        mark = None if high is None else high - lateness
        times = []
        for row in sorted(rows, key=lambda r: r[1] or ""):
            try:
                at = seconds(row[1])
            except (TypeError, ValueError):
                aside.append((row[0], "unreadable"))
                continue
            times.append(at)
            closes = (at // width + 1) * width
            if mark is not None and closes <= mark:
                aside.append((row[0], "late"))
            elif row[0] is not None and open_keys.get(row[0], -1) > (mark if mark is not None else -1):
                aside.append((row[0], "repeated"))
            else:
                counted.append(row)
                open_keys[row[0]] = closes
        high = max([*times, *([high] if high is not None else [])], default=None)
    return counted, aside


def test_late_repeated_and_unreadable_events_are_put_aside(spark, tmp_path):
    rng = random.Random(7)
    at = lambda minutes: str(datetime(2024, 1, 1) + timedelta(minutes=minutes))
    batches = []
    for b in range(3):
        rows = [(rng.randrange(60), at(b * 120 + rng.randrange(-150 * (b > 0), 120)), rng.choice("ab"), rng.choice([None, 1.0, 20.0])) for _ in range(40)]
        batches.append(rows + [(900 + b, "whenever", "a", 1.0), (910 + b, None, "a", 1.0), (None, at(b * 120 + 1), "b", 2.0), (None, at(b * 120 + 1), "b", 2.0)])
    counting = SW.Counting("at", "id", "kind", "value", F.col("value") > 10, width="30 minutes", lateness="45 minutes")
    out, path = scratch_path(spark, "counts"), str(tmp_path / "events")
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
        # a new query each time goes on from the last one's state
        SW.start_counting(spark.readStream.schema(EVENTS).parquet(path), counting, out, f"{out}-state").awaitTermination()
    counted, aside = counted_by_hand(batches, 1800, 2700)
    found = sorted((str(r["id"]), r["reason"]) for r in SW.read_aside(spark, out).collect())
    assert found == sorted((str(i), reason) for i, reason in aside) and {r for _, r in aside} == {"late", "repeated", "unreadable"}
    total = SW.read_progress(spark, out).agg(*[F.sum(n).alias(n) for n in ("rows", "counted", "unreadable", "late", "repeated")]).first()
    assert total["rows"] == sum(map(len, batches)) == total["counted"] + total["unreadable"] + total["late"] + total["repeated"]
    expected = {}
    for _, t, kind, value in counted:
        start = datetime.fromisoformat(t)
        slot = expected.setdefault((start.replace(minute=start.minute // 30 * 30), kind), [0, 0, 0])
        slot[0] += 1
        slot[1] += value is None
        slot[2] += (value or 0) > 10
    got = {(r["window_start"], r["group"]): [r["rows"], r["nulls"], r["bad"]] for r in SW.read_counts(spark, out, counting, closed_only=False).collect()}
    assert got == expected
    # a batch that runs again writes the same again
    closed = SW.read_counts(spark, out, counting)
    assert 0 < closed.count() < len(got)


def test_sessions_merge_over_batches(spark, tmp_path):
    at = lambda minutes: str(datetime(2024, 1, 1) + timedelta(minutes=minutes))
    batches = [[(1, at(0), "a", 1.0), (2, at(8), "a", 2.0), (3, at(30), "a", 3.0)], [(4, at(16), "a", 4.0), (5, at(23), "a", 5.0), (6, at(60), "b", None)]]
    counting = SW.Counting("at", "id", "kind", "value", F.col("value") > 10, lateness="1 hour", gap="10 minutes")
    out, path = scratch_path(spark, "sessions"), str(tmp_path / "events")
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
        SW.start_counting(spark.readStream.schema(EVENTS).parquet(path), counting, out, f"{out}-state").awaitTermination()
    rows = SW.read_counts(spark, out, counting, closed_only=False).collect()
    minute = lambda t: (t - datetime(2024, 1, 1)).total_seconds() / 60
    assert sorted((r["group"], minute(r["window_start"]), minute(r["window_end"]), r["rows"], r["max"]) for r in rows) == [("a", 0, 40, 5, 5.0), ("b", 60, 70, 1, None)]


def test_unreadable_times_are_counted_or_refused(spark, frame):
    rows = [(1, "2024-01-01 10:00:00", "a", 1.0), (2, "whenever", "a", 20.0), (3, None, "b", None)]
    df = frame(rows, "id int, at string, status string, value double")
    build = lambda d: SW.window_metrics(d, "at", "id", "status", "value", F.col("value") > 10)
    found = {(r["window_start"] is None, r["group"]): (r["rows"], r["bad"]) for r in build(df).collect()}
    assert found == {(False, "a"): (1, 0), (True, "a"): (1, 1), (True, "b"): (1, 0)}
    path = scratch_path(spark, "untimed")
    df.write.parquet(path)
    metrics = build(spark.readStream.schema(df.schema).parquet(path))
    with pytest.raises(Exception, match="unreadable event time"):
        SW.start_window_stream(metrics, scratch_path(spark, "o"), scratch_path(spark, "c")).awaitTermination()


def test_batches_of_the_registered_streams_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from registry import streaming as R

    rows = spark.range(400).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id AS int)) AS ts", "'click' AS event_type", "id % 5 AS user_id", "1.0D AS value")
    rows.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(R, "scratch_path", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        progress = R.stream_aside(spark, str(tmp_path)).collect()[0]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # every seventh is in the second batch with its repeats: 31 of the 343 others by 11, 31 of all by 13
    assert (progress["rows"], progress["unreadable"]) == (343 + 57 + sum(i % 11 == 0 and i % 7 != 0 for i in range(400)) + 31, 31)
    assert len(list((tmp_path / "events").glob("*.parquet"))) > 2
