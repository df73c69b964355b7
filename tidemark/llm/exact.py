"""Exact duplicates by a stream with keyed state on disk; built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, scratch_path

#: Up to so many digests (75 MB with what is known of them) go to every task; more meet the rows in a shuffle that
#: deals each of them out in so many parts.
BROADCAST_HITS, PARTS = 250_000, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # no files allocated ahead: several MB for every partition of the state, however small
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normal(text: Column) -> Column:
    """The text with A-Z lower-cased; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digest_state(spark: SparkSession, arriving: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of (``digest``, ``doc_id``, ``locator``) rows to its end; the state of every digest.

    The state lives in RocksDB on the executors' disks, is logged to ``folder``
    in the shared folder and never expires: per digest the number of rows, the
    largest ``doc_id`` and the locator of its content. A run that is started
    again with the same folder goes on where the last one ended. Each
    micro-batch writes the digests it touched; counts and ids only grow, so the
    largest of them are the present state.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changed/batch={batch}")

    kept = arriving.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("last"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for key, value in STATE.items():
            spark.conf.set(key, value)
        query = (
            kept.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    query.awaitTermination()
    changed = spark.read.schema("digest binary, n long, last struct<doc_id: bigint, locator: string>").parquet(f"{folder}/changed/*")
    return changed.groupBy("digest").agg(F.max("n").alias("n"), F.max("last").alias("last"))


def _meet(rows: DataFrame, listed: DataFrame, how: str, most: int) -> DataFrame:
    """``rows`` joined by ``digest`` with a table of distinct ones; the rows of one digest are never all moved to one task."""
    if listed.count() <= most:
        return rows.join(F.broadcast(listed), "digest", how)
    parts = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    return dealt.join(parts.hint("shuffle_hash"), ["digest", "part"], how).drop("part")


def exact_groups(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 100_000, broadcast_hits: int = BROADCAST_HITS
) -> DataFrame:
    """``doc_id``, ``text_sha256``, ``keep_id``, ``group_size``, ``locator`` and ``kept`` for every row of ``docs``.

    Reads ``doc_id`` and ``text`` only. Texts are equal if they are identical
    after lower-casing A-Z; null is empty. The row with the largest ``doc_id``
    stays; null ids are smaller than all others, and a group of null ids keeps
    them all, as they cannot be told apart. Rows that repeat both ``doc_id``
    and text are one document listed twice and share its fate. ``locator`` names
    the file that the kept row was read from (empty if it came from no file).

    A digest that was met more than once is only a hit: the whole texts of its
    rows, and no others, are grouped byte by byte, copies within a task first,
    and texts that merely share a digest become groups of their own.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "exact")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("text"), F.input_file_name().alias("locator"))
    marked_schema = "doc_id long, digest binary, text_sha256 binary, locator string"
    text.select("doc_id", digest(F.col("text")).cast("binary").alias("digest"), sha256(F.col("text")).alias("text_sha256"), "locator").write.parquet(f"{folder}/marked")
    marked = spark.read.schema(marked_schema).parquet(f"{folder}/marked")
    arriving = spark.readStream.schema(marked_schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/marked")
    if marked.isEmpty():
        state = spark.createDataFrame([], "digest binary, n long, last struct<doc_id: bigint, locator: string>")
    else:
        state = cut_lineage(digest_state(spark, arriving.select("digest", "doc_id", "locator"), folder))
    hits = cut_lineage(state.where("n > 1"))
    by_digest = text.select(digest(F.col("text")).cast("binary").alias("digest"), "doc_id", "text", "locator")
    hit_texts = _meet(by_digest, hits.select("digest"), "left_semi", broadcast_hits)
    collided = cut_lineage(hit_texts.select("digest", "text").distinct().groupBy("digest").count().where("count > 1").select("digest"))
    # the state has the answer for a digest whose texts are all the same bytes; one met once is its own
    met = _meet(marked, hits.select("digest", "n", "last"), "left", broadcast_hits)
    alone = F.struct("doc_id", "locator")
    met = met.withColumn("last", F.when(F.col("n").isNull(), alone).otherwise(F.col("last"))).withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    answer = ["doc_id", "text_sha256", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("last.locator").alias("locator")]
    if collided.isEmpty():
        result = met.select(*answer)
    else:
        apart = _meet(by_digest, collided, "left_semi", broadcast_hits)
        by_text = apart.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("last"))
        own = apart.drop("locator").join(by_text, ["digest", "text"])
        whole = met.join(collided, "digest", "left_anti")
        result = whole.select(*answer).union(own.withColumn("text_sha256", sha256(F.col("text"))).select(*answer))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_keep(docs: DataFrame, broadcast_gone: int = BROADCAST_HITS) -> DataFrame:
    """The rows of ``docs`` that stay; columns unchanged."""
    gone = exact_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")).distinct()
    gone = cut_lineage(gone)
    listed = F.broadcast(gone) if gone.count() <= broadcast_gone else gone.hint("shuffle_hash")
    same = docs["doc_id"].cast("long").eqNullSafe(listed["gone_id"]) & (sha256(normal(docs["text"])) == listed["gone_text"])
    return docs.join(listed, same, "left_anti")
