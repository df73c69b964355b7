"""Streams over the events table, drained with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.streaming import rules as SR
from tidemark.streaming import windows as SW

from .fixtures import load

RULES = [
    {"type": "range", "column": "value", "min": 0.5, "max": 200},
    {"type": "in_set", "column": "event_type", "values": ["click", "view", "purchase", "signup"]},
    {"type": "not_null", "column": "user_id"},
]


def event_stream(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_rules(spark, sf_dir):
    stream = event_stream(spark, sf_dir)
    out, checkpoint = scratch_path(spark, "judged"), scratch_path(spark, "judged-state")
    SR.start_rule_stream(stream, RULES, out, checkpoint, stream.columns).awaitTermination()
    return SR.read_judged(spark, out).select("event_id", "verdict", F.array_join("reasons", ",").alias("reasons"))


def _metrics(events):
    return SW.window_metrics(events, "ts", "event_id", "event_type", "value", F.col("value") > 200)


def stream_window_metrics(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "windows-state")
    metrics = _metrics(event_stream(spark, sf_dir))
    SW.start_window_stream(metrics, out, checkpoint).awaitTermination()
    closed = spark.read.schema(metrics.schema).parquet(out)
    return closed.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


WHOLE_SET = [
    *RULES,
    {"type": "uniqueness", "columns": ["user_id", "event_type"]},
    {"type": "foreign_key", "column": "user_id", "reference": "customer", "reference_column": "c_custkey"},
]


def stream_set_rules(spark, sf_dir):
    """Row rules, a uniqueness rule and a foreign key, judged on the stream."""
    stream = event_stream(spark, sf_dir)
    out, checkpoint = scratch_path(spark, "judged"), scratch_path(spark, "judged-state")
    SR.start_rule_stream(stream, WHOLE_SET, out, checkpoint, references={"customer": load(spark, sf_dir, "customer")}).awaitTermination()
    return SR.read_judged(spark, out, WHOLE_SET).select("event_id", "verdict", F.array_join("reasons", ",").alias("reasons"))


def _counted(spark, sf_dir, **options):
    """All events in two batches: the second holds every seventh, some of the first again, and some whose time is no time."""
    events = load(spark, sf_dir, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    seventh = F.col("event_id") % 7 == 0
    late = events.where(seventh).unionByName(events.where(~seventh & (F.col("event_id") % 11 == 0)))
    late = late.unionByName(events.where(F.col("event_id") % 13 == 0).withColumn("at", F.lit("no time")))
    root, out = scratch_path(spark, "events"), scratch_path(spark, "counts")
    counting = SW.Counting("at", "event_id", "event_type", "value", F.col("value") > 200, **options)
    for part in (events.where(~seventh), late):
        part.write.mode("append").parquet(root)
        stream = spark.readStream.schema(part.schema).parquet(root)
        SW.start_counting(stream, counting, out, f"{out}-state").awaitTermination()
    return out, counting


def _texts(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).drop("window_end")


def stream_counts(spark, sf_dir):
    out, counting = _counted(spark, sf_dir)
    return _texts(SW.read_counts(spark, out, counting))


def stream_aside(spark, sf_dir):
    """Rows in, counted and put aside, over all batches."""
    out, _ = _counted(spark, sf_dir)
    names = ("rows", "counted", "unreadable", "late", "repeated")
    return SW.read_progress(spark, out).agg(*[F.sum(n).alias(n) for n in names]).withColumn("aside", F.lit(SW.read_aside(spark, out).count()))


def stream_sessions(spark, sf_dir):
    out, counting = _counted(spark, sf_dir, gap="2 minutes", lateness="400 days")
    return _texts(SW.read_counts(spark, out, counting, closed_only=False))


QUERIES = {
    "stream_rules": stream_rules, "stream_window_metrics": stream_window_metrics, "stream_set_rules": stream_set_rules,
    "stream_counts": stream_counts, "stream_aside": stream_aside, "stream_sessions": stream_sessions,
}

# the two batches, and what becomes of each row
ARRIVED = """
  mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark, max(ts) AS high FROM events WHERE event_id % 7 <> 0),
  arrived AS (
    SELECT *, 'counted' AS fate FROM events WHERE event_id % 7 <> 0
    UNION ALL SELECT e.*, CASE WHEN time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= mark THEN 'late' ELSE 'counted' END FROM events e, mark WHERE event_id % 7 = 0
    UNION ALL SELECT e.*, CASE WHEN time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= mark THEN 'late' ELSE 'repeated' END FROM events e, mark
      WHERE event_id % 7 <> 0 AND event_id % 11 = 0
    UNION ALL SELECT *, 'unreadable' FROM events WHERE event_id % 13 = 0)"""
_COUNTS = """event_type AS "group", count(*) AS rows, count(*) - count(value) AS nulls, count(*) FILTER (WHERE value > 200) AS bad, round(min(value), 4) AS min, round(max(value), 4) AS max"""

ORACLE = {
    "stream_set_rules": """
        SELECT event_id, CASE WHEN reasons = '' THEN 'valid' ELSE 'quarantine' END AS verdict, reasons FROM (
          SELECT event_id, concat_ws(',', CASE WHEN value < 0.5 OR value > 200 THEN 'range_value' END,
            CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'in_set_event_type' END,
            CASE WHEN count(*) OVER (PARTITION BY user_id, event_type) > 1 THEN 'uniqueness_user_id_event_type' END,
            CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer) THEN 'foreign_key_user_id' END) AS reasons FROM events) AS e""",
    "stream_counts": f"""
        WITH {ARRIVED} SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, {_COUNTS}
        FROM arrived WHERE fate = 'counted' GROUP BY time_bucket(INTERVAL 1 DAY, ts), event_type
        HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_aside": f"""
        WITH {ARRIVED} SELECT count(*) AS rows, count(*) FILTER (WHERE fate = 'counted') AS counted, count(*) FILTER (WHERE fate = 'unreadable') AS unreadable,
          count(*) FILTER (WHERE fate = 'late') AS late, count(*) FILTER (WHERE fate = 'repeated') AS repeated, count(*) FILTER (WHERE fate <> 'counted') AS aside FROM arrived""",
    # nothing is late there; sessions do not show in which batch an event came
    "stream_sessions": f"""
        WITH stepped AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 2 MINUTE THEN 1 ELSE 0 END AS apart FROM events),
        numbered AS (SELECT *, sum(apart) OVER (PARTITION BY event_type ORDER BY ts) AS session FROM stepped)
        SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, {_COUNTS} FROM numbered GROUP BY event_type, session""",
    "stream_rules": """
        SELECT event_id, CASE WHEN reasons = '' THEN 'valid' ELSE 'quarantine' END AS verdict, reasons FROM (
          SELECT event_id, concat_ws(',', CASE WHEN value < 0.5 OR value > 200 THEN 'range_value' END,
            CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'in_set_event_type' END) AS reasons FROM events) AS e""",
    # only windows that end before the last event less the allowed lateness are closed
    "stream_window_metrics": """
        SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS window_start, event_type AS "group", count(*) AS rows,
          count(*) - count(value) AS nulls, count(*) FILTER (WHERE value > 200) AS bad, round(min(value), 4) AS min, round(max(value), 4) AS max
        FROM events GROUP BY time_bucket(INTERVAL 1 DAY, ts), event_type
        HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
}
