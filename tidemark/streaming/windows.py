"""Quality metrics per event-time window, with late data and repeats handled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.missing import quoted
from ..session import cut_lineage


def _measures(value: str, bad: Column) -> list[Column]:
    column = F.col(quoted(value))
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(column.isNull()).alias("nulls"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"),
        F.round(F.min(column), 4).alias("min"),
        F.round(F.max(column), 4).alias("max"),
    ]


def window_metrics(
    events: DataFrame, time: str, key: str, group: str, value: str, bad: Column,
    width: str = "1 day", lateness: str = "1 hour",
) -> DataFrame:
    """Rows, nulls, bad values and bounds per window and group.

    On a stream, an event repeated within the allowed lateness counts once and
    a window is given out when the watermark has passed its end. Events whose
    time cannot be read are counted under a window that is NULL; a stream has
    no time to give such a window out, so it fails at the first one.
    """
    # a watermark needs an instant; local times are read in the session's time zone
    stamped = events.withColumn("__at", F.col(quoted(time)).try_cast("timestamp"))
    at, measures = F.col("__at"), _measures(value, bad)
    name = F.col(quoted(group)).alias("group")
    if events.isStreaming:
        refused = F.raise_error(F.concat(F.lit("unreadable event time: "), F.coalesce(F.col(quoted(time)).cast("string"), F.lit("NULL"))))
        stamped = stamped.withColumn("__at", F.coalesce(at, refused.cast("timestamp")))
        stamped = stamped.withWatermark("__at", lateness).dropDuplicatesWithinWatermark([key])
        return stamped.groupBy(F.window("__at", width).alias("w"), name).agg(*measures).select(*_columns(F.col("w.start")))
    stamped = stamped.dropDuplicates([key])
    timed = stamped.groupBy(F.window("__at", width).alias("w"), name).agg(*measures).select(*_columns(F.col("w.start")))
    untimed = stamped.where(at.isNull()).groupBy(name).agg(*measures).select(*_columns(F.lit(None).cast("timestamp")))
    return timed.unionByName(untimed)


def _columns(start: Column) -> list[Column]:
    return [start.alias("window_start"), *[F.col(c) for c in ("group", "rows", "nulls", "bad", "min", "max")]]


def start_window_stream(metrics: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (
        metrics.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


UNREADABLE, LATE, REPEATED = "unreadable", "late", "repeated"


@dataclass(frozen=True)
class Counting:
    """What is counted: windows of ``width``, or with ``gap`` sessions that end after a pause of that length.

    ``time``, ``key``, ``group`` and ``value`` are columns; ``bad`` tells bad values.
    """

    time: str
    key: str
    group: str
    value: str
    bad: Column
    width: str = "1 day"
    lateness: str = "1 hour"
    gap: str | None = None


PARTIAL = "start timestamp, end timestamp, group string, rows long, nulls long, bad long, min double, max double, batch long"
PROGRESS = "high long, rows long, counted long, unreadable long, late long, repeated long, batch long"


def _written(spark: SparkSession, out: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """What the batches, or those before one, have written."""
    if before == 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{out}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def _micros(spark: SparkSession, length: str) -> int:
    return spark.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {length})")).first()[0]


def _watermark(spark: SparkSession, out: str, lateness: int, before: int | None = None) -> int | None:
    """The latest event time less the lateness, in microseconds."""
    high = _written(spark, out, "progress", PROGRESS, before).agg(F.max("high")).first()[0]
    return None if high is None else high - lateness


def start_counting(events: DataFrame, counting: Counting, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Counts a stream by window and group, and puts every event aside that it cannot count.

    An event is put aside as ``unreadable`` if its time is no time, as
    ``late`` if its window (or its own session) had ended before the latest
    event of earlier batches less ``lateness``, and as ``repeated`` if an event
    of the same key was counted whose window is still open; a null key repeats
    nothing. All rows that come in are counted or put aside. Below ``out`` a batch
    owns ``batch=<id>`` of ``windows`` (partial counts, which add up),
    ``aside``, ``keys`` and ``progress``; it reads earlier batches only,
    so one that is repeated after a failure writes the same again.
    """
    c = counting
    key_type = events.schema[c.key].dataType.simpleString()

    def count(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lateness = _micros(spark, c.lateness)
        mark = _watermark(spark, out, lateness, batch_id)
        ended = F.lit(mark).cast("long")
        stamped = batch.withColumn("__at", F.col(quoted(c.time)).try_cast("timestamp")).withColumn("__row", F.monotonically_increasing_id())
        end = F.window("__at", c.width)["end"] if c.gap is None else F.col("__at") + F.expr(f"INTERVAL {c.gap}")
        # window() leaves out rows without a time, so they are told first
        untimed = stamped.where(F.col("__at").isNull()).withColumn("__closes", F.lit(None).cast("long"))
        timed = stamped.where(F.col("__at").isNotNull()).withColumn("__closes", F.unix_micros(end))
        rows = cut_lineage(untimed.unionByName(timed))
        open_rows = rows.where(F.col("__closes") > F.coalesce(ended, F.lit(-(1 << 62))))
        key = F.col(quoted(c.key))
        first = open_rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.min(F.struct("__at", "__row")).alias("first"))
        known = _written(spark, out, "keys", f"key {key_type}, closes long, batch long", batch_id)
        known = known.where(F.col("closes") > F.coalesce(ended, F.lit(-(1 << 62)))).select("key").distinct()
        fresh = first.join(known, "key", "left_anti").select(F.col("first.__row").alias("__row"), F.lit(True).alias("__fresh"))
        reason = (
            F.when(F.col("__at").isNull(), UNREADABLE)
            .when(F.col("__closes") <= ended, LATE)
            .when(key.isNotNull() & F.col("__fresh").isNull(), REPEATED)
        )
        judged = cut_lineage(rows.join(fresh, "__row", "left").withColumn("reason", reason))
        mine = lambda name: f"{out}/{name}/batch={batch_id}"
        counted = judged.where(F.col("reason").isNull())
        span = F.window("__at", c.width) if c.gap is None else F.session_window("__at", c.gap)
        partial = counted.groupBy(span.alias("w"), F.col(quoted(c.group)).cast("string").alias("group")).agg(*_measures(c.value, c.bad))
        partial.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "group", "rows", "nulls", "bad", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max")).write.mode("overwrite").parquet(mine("windows"))
        judged.where(F.col("reason").isNotNull()).select(*[F.col(quoted(n)) for n in batch.columns], "reason").write.mode("overwrite").parquet(mine("aside"))
        counted.where(key.isNotNull()).select(key.alias("key"), F.col("__closes").alias("closes")).write.mode("overwrite").parquet(mine("keys"))
        told = [F.count_if(F.col("reason") == r).alias(r) for r in (UNREADABLE, LATE, REPEATED)]
        total = judged.agg(F.unix_micros(F.max("__at")).alias("high"), F.count("*").alias("rows"), F.count_if(F.col("reason").isNull()).alias("counted"), *told)
        total.write.mode("overwrite").parquet(mine("progress"))

    return events.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_counts(spark: SparkSession, out: str, counting: Counting, closed_only: bool = True) -> DataFrame:
    """(window_start, window_end, group, rows, nulls, bad, min, max) of what a stream has counted.

    Partial sessions that lie no longer than the pause apart are one. A window
    is closed when the latest event less the lateness has passed its end.
    """
    parts = _written(spark, out, "windows", PARTIAL)
    if counting.gap is not None:
        order = Window.partitionBy("group").orderBy("start", "end")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("apart", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(False)).cast("int"))
        parts = parts.withColumn("session", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        keys = ["group", "session"]
    else:
        keys = ["group", "start"]
    total = [F.sum(n).alias(n) for n in ("rows", "nulls", "bad")]
    merged = parts.groupBy(*keys).agg(F.min("start").alias("window_start"), F.max("end").alias("window_end"), *total, F.min("min").alias("min"), F.max("max").alias("max"))
    if closed_only:
        mark = _watermark(spark, out, _micros(spark, counting.lateness))
        merged = merged.where(F.unix_micros("window_end") <= F.lit(mark).cast("long"))
    return merged.select("window_start", "window_end", "group", "rows", "nulls", "bad", "min", "max")


def read_aside(spark: SparkSession, out: str) -> DataFrame:
    """The events put aside, each with its ``reason``."""
    return spark.read.option("basePath", f"{out}/aside").parquet(f"{out}/aside")


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    """Rows in, rows counted and rows put aside by reason, per batch."""
    return _written(spark, out, "progress", PROGRESS)
