"""The rules of the batch engine on streams."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.missing import quoted
from ..operators.rules import QUARANTINE, ROW_RULES, SET_RULES, VALID, named_rules, rule_columns, with_violations


def require_columns(df: DataFrame, expected: Iterable[str]) -> None:
    """A stream of another shape is refused before it starts."""
    expected = set(expected)
    if set(df.columns) != expected:
        raise ValueError(f"Schema mismatch: expected {sorted(expected)}, found {sorted(df.columns)}")


def judged(df: DataFrame, rules: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Every row with its ``reasons`` and its ``verdict``; works on streams and tables."""
    flagged = with_violations(df, rules, "reasons")
    return flagged.withColumn("verdict", F.when(F.size("reasons") == 0, VALID).otherwise(QUARANTINE))


class RuleStream:
    """The queries of one rule stream, run and stopped together."""

    def __init__(self, queries: list[StreamingQuery]):
        self.queries = queries

    def awaitTermination(self) -> None:
        for query in self.queries:
            query.awaitTermination()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def _of_type(rules: list[dict], kind: str) -> list[tuple[int, dict]]:
    return [(number, rule) for number, rule in enumerate(rules) if rule["type"] == kind]


def start_rule_stream(
    stream: DataFrame,
    rules: list[Mapping[str, Any]],
    out: str,
    checkpoint: str,
    expected_columns: Iterable[str] | None = None,
    trigger: Mapping[str, Any] | None = None,
    references: Mapping[str, DataFrame] | None = None,
) -> RuleStream:
    """Writes each micro-batch once, split into ``verdict=valid`` and ``verdict=quarantine``.

    A batch owns the folder ``batch=<id>`` and overwrites it, so a batch that
    is repeated after a failure leaves no second copy. Foreign keys meet the
    tables in ``references``, as they are when the batch runs. A uniqueness
    rule has a query of its own, whose state counts every key for good; keys
    met twice are written, and ``read_judged`` turns the rows that hold them,
    the earlier ones included.
    """
    named = list(named_rules(stream, rules, ROW_RULES | SET_RULES))
    if expected_columns is not None:
        require_columns(stream, expected_columns)
    own = [rule for rule in named if rule["type"] != "uniqueness"]

    def save(batch: DataFrame, batch_id: int) -> None:
        flagged = with_violations(batch, own, "reasons", references)
        rows = flagged.withColumn("verdict", F.when(F.size("reasons") == 0, VALID).otherwise(QUARANTINE))
        rows.write.mode("overwrite").partitionBy("verdict").parquet(f"{out}/batch={batch_id}")

    def start(rows: DataFrame, mode: str, write, state: str) -> StreamingQuery:
        writer = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    queries = [start(stream, "append", save, checkpoint)]
    for number, rule in _of_type(named, "uniqueness"):
        counted = stream.groupBy(*[F.col(quoted(c)) for c in rule_columns(rule)]).agg(F.count(F.lit(1)).alias("__rows"))

        def keep(batch: DataFrame, batch_id: int, number: int = number) -> None:
            batch.where("__rows > 1").drop("__rows").write.mode("overwrite").parquet(f"{out}/repeated={number}/batch={batch_id}")

        queries.append(start(counted, "update", keep, f"{checkpoint}/unique={number}"))
    return RuleStream(queries)


def read_judged(spark: SparkSession, out: str, rules: list[Mapping[str, Any]] | None = None) -> DataFrame:
    """The rows a rule stream has written; with its ``rules`` the uniqueness rules among them are judged too.

    A row breaks uniqueness if its key came twice so far, before it or after
    it, as it does in a table of the same rows.
    """
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    columns = [c for c in rows.columns if c not in ("reasons", "verdict", "batch")]
    named = list(named_rules(rows.select(*columns), rules or [], ROW_RULES | SET_RULES))
    unique = _of_type(named, "uniqueness")
    if not unique:
        return rows
    broken = F.col("reasons")
    for number, rule in unique:
        keys = rule_columns(rule)
        # a key is written again whenever it comes again
        found = spark.read.schema(rows.select(*map(quoted, keys)).schema).parquet(f"{out}/repeated={number}/batch=*").distinct()
        found = found.select(*[F.col(quoted(c)).alias(f"__key_{number}_{i}") for i, c in enumerate(keys)], F.lit(True).alias(f"__mark_{number}"))
        same = [F.col(quoted(c)).eqNullSafe(F.col(f"__key_{number}_{i}")) for i, c in enumerate(keys)]
        rows = rows.join(found, reduce(operator.and_, same), "left")
        broken = F.concat(broken, F.array_compact(F.array(F.when(F.col(f"__mark_{number}"), F.lit(rule["name"])))))
    ordered = F.filter(F.array(*[F.lit(rule["name"]) for rule in named]), lambda name: F.array_contains(broken, name))
    judged_rows = rows.withColumn("reasons", ordered).withColumn("verdict", F.when(F.size("reasons") == 0, VALID).otherwise(QUARANTINE))
    return judged_rows.select(*[F.col(quoted(c)) for c in columns], "reasons", "batch", "verdict")
