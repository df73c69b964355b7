"""A stored inverted index of document chunks: built once, searched many times, kept up in segments.

Chunks of a document are numbered one after another within a bucket; 64 of
them are a block. A posting says in which chunks of a block a word stands: the
bits of one number. A search reads the postings of its words and deals them
out by block. A task keeps the k best documents of each query; the weights of
the words that a block holds add up to the largest score it can give, and a
block below the running k-th score of a query is not scored for it. Only those
k rows per query and task move on.

An import writes a segment and reads no other. A deletion writes marks: the
dead chunks of a block and how many documents less each word has. Merging
writes several segments as one, from their postings; the words of the texts
stay where they are. The manifest lists what is valid, so a half-written
segment is never read; a change made from an old version fails.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType

from ..functions.text import split_words
from ..session import cut_lineage, spread
from .chunking import CHUNK_OVERLAP, CHUNK_SIZE, window

# tasks get these functions by value, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 64
#: Bytes of text for a bucket; a task builds one after another, with about 40 times as much memory.
BUCKET_BYTES = 4_000_000
#: New buckets that a task of a merge makes together.
MERGED_BUCKETS = 4
#: Words of queries that are searched in one pass and known to every task; more queries take more passes.
PASS_WORDS = 200_000
#: Passages that are met as a broadcast list by the stored texts; for more of them the texts are shuffled.
MOST_HITS = 200_000
# Scores are sums of logarithms; rounding keeps ties ties in any order of addition.
SCORE_DIGITS = 10
ABSENT_IDF = 0.1

#: What is stored, by segment and bucket; marks of deletions have a table of the same columns each.
TABLES = {
    "texts": "id {id}, words array<string>",
    "documents": "id {id}, begin long, chunks int, origin int, home int",
    "blocks": "block long, ids array<{id}>, numbers array<int>",
    # the first posting of a word in a bucket that was imported says how many documents there have it
    "postings": "term string, block long, bits long, documents long",
    "terms": "term string, frequency long",
    "dead": "id {id}, block long, bits long",
}
ADDRESS = ["segment", "bucket", "block"]
MADE = "bucket int, block long, term string, bits long, documents long"
CELL = "group int, terms array<string>, sizes array<int>, buckets array<int>, blocks array<int>, slots array<tinyint>"


def _fresh() -> int:
    """A name that no other writer takes."""
    return random.SystemRandom().randrange(1, 1 << 31)


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.cast("int"))


def _rounded(score: Column) -> Column:
    # plain arithmetic: round() goes through decimals, row by row
    unit = float(10**SCORE_DIGITS)
    return F.floor(score * unit + 0.5) / unit


class SearchIndex:
    """The index stored at ``path``; ``create`` makes an empty one, ``add``, ``delete`` and ``merge`` change it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        entries = spark.read.parquet(f"{self.path}/manifest")
        # an entry per segment and per mark
        last = [r for r in entries.where(F.col("version") == entries.agg(F.max("version")).first()[0]).collect()]
        self.version = last[0]["version"]
        names = {kind: sorted(r["name"] for r in last if r["kind"] == kind) for kind in ("setting", "segment", "mark")}
        self.segments, self.marks = list(map(int, names["segment"])), list(map(int, names["mark"]))
        settings = dict(s.split("=") for s in names["setting"])
        self.id_type, self.chunk_size, self.overlap = settings["id"], int(settings["chunk_size"]), int(settings["overlap"])
        self.words, self.stride = window(self.chunk_size, self.overlap)

    @classmethod
    def create(cls, spark: SparkSession, path: str, id_type: str = "bigint", chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> SearchIndex:
        window(chunk_size, overlap)
        cls._publish(spark, path.rstrip("/"), 0, [], [], [f"id={id_type}", f"chunk_size={chunk_size}", f"overlap={overlap}"])
        return cls(spark, path)

    @staticmethod
    def _publish(spark: SparkSession, path: str, version: int, segments: list[int], marks: list[int], settings: list[str]) -> None:
        rows = [("segment", str(s)) for s in segments] + [("mark", str(m)) for m in marks] + [("setting", s) for s in settings]
        entries = spark.createDataFrame(rows, "kind string, name string").coalesce(1)
        entries.write.parquet(f"{path}/manifest/version={version}")

    def _changed(self, segments: list[int], marks: list[int]) -> SearchIndex:
        settings = [f"id={self.id_type}", f"chunk_size={self.chunk_size}", f"overlap={self.overlap}"]
        self._publish(self.spark, self.path, self.version + 1, segments, marks, settings)
        return SearchIndex(self.spark, self.path)

    # storage

    def _table(self, name: str, marks: bool = False) -> DataFrame:
        """Rows of the valid segments, or of the valid marks on them."""
        columns = TABLES[name].format(id=self.id_type)
        if marks:
            if not self.marks:
                return self.spark.createDataFrame([], f"{columns}, segment int, bucket int, mark int")
            rows = self.spark.read.schema(f"{columns}, segment int, bucket int, mark int").parquet(f"{self.path}/{name}_marks")
            return rows.where(F.col("segment").isin(self.segments) & F.col("mark").isin(self.marks))
        if not self.segments:
            return self.spark.createDataFrame([], f"{columns}, segment int, bucket int")
        rows = self.spark.read.schema(f"{columns}, segment int, bucket int").parquet(f"{self.path}/{name}")
        return rows.where(F.col("segment").isin(self.segments))

    def _store(self, rows: DataFrame, name: str, segment: int) -> None:
        rows = rows.withColumn("segment", F.lit(segment))
        rows.write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.path}/{name}")

    def _new(self, name: str, segment: int) -> DataFrame:
        columns = TABLES[name].format(id=self.id_type)
        return self.spark.read.schema(f"{columns}, segment int, bucket int").parquet(f"{self.path}/{name}").where(F.col("segment") == segment)

    def documents(self) -> DataFrame:
        """(segment, bucket, id, begin, chunks, origin, home) of the documents that are not deleted."""
        rows = self._table("documents")
        return rows.join(self._table("dead", marks=True).select("segment", "id").distinct(), ["segment", "id"], "left_anti") if self.marks else rows

    def _postings(self) -> DataFrame:
        """Postings without the chunks that are deleted."""
        rows = self._table("postings")
        if not self.marks:
            return rows
        dead = self._table("dead", marks=True).groupBy(*ADDRESS).agg(F.bit_or("bits").alias("dead"))
        alive = rows.join(dead, ADDRESS, "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("dead", F.lit(0).cast("long")))))
        return alive.where(F.col("bits") != 0).drop("dead")

    # upkeep

    def _numbered(self, rows: DataFrame, buckets: int) -> DataFrame:
        """``begin``: the number of a document's first chunk in its bucket."""
        before = Window.partitionBy("bucket").orderBy("id", "chunks").rowsBetween(Window.unboundedPreceding, -1)
        begin = F.coalesce(F.sum(F.col("chunks").cast("long")).over(before), F.lit(0).cast("long"))
        return rows.repartition(buckets, "bucket").withColumn("begin", begin)

    def _store_blocks(self, segment: int, buckets: int) -> None:
        """The document and the number of each chunk of a block, by slot."""
        each = self._new("documents", segment).where("chunks > 0")
        each = each.select("bucket", "id", "begin", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("number"))
        at = F.col("begin") + F.col("number")
        placed = F.struct((at % BLOCK).cast("int").alias("slot"), "id", "number")
        blocks = each.repartition(buckets, "bucket").groupBy("bucket", F.floor(at / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(placed)).alias("slots"))
        self._store(blocks.select("bucket", "block", F.col("slots.id").alias("ids"), F.col("slots.number").alias("numbers")), "blocks", segment)

    @staticmethod
    def _chunks(blocks: DataFrame) -> DataFrame:
        """(segment, bucket, block, slot, id, chunk_no)."""
        pairs = F.arrays_zip("ids", "numbers")
        return blocks.select(*ADDRESS, F.posexplode(pairs).alias("slot", "c")).select(*ADDRESS, "slot", F.col("c.ids").alias("id"), F.col("c.numbers").alias("chunk_no"))

    def add(self, documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None) -> SearchIndex:
        """The index with the documents added whose id it does not hold yet.

        Only the new texts are read; they are cut into words once. A null id
        is left out, ids are taken to differ within one import. A document
        without words counts as a document and has no chunks. ``buckets`` are
        one per ``BUCKET_BYTES`` of text, at least as many as the session has
        shuffle partitions, unless given.
        """
        segment = _fresh()
        if not buckets:
            size = documents.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
            buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        named = spread(documents.select(F.col(id_column).cast(self.id_type).alias("id"), F.col(text_column).alias("text")), "id")
        fresh = named.select("id", split_words(F.col("text")).alias("words")).where("id IS NOT NULL")
        if self.segments:
            fresh = fresh.join(self.documents().select("id"), "id", "left_anti")
        placed = fresh.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket")
        self._store(placed, "texts", segment)
        texts = self._new("texts", segment)
        chunks = F.ceil(F.size("words") / self.stride).cast("int")
        counted = texts.select("bucket", "id", chunks.alias("chunks"))
        numbered = self._numbered(counted, buckets).withColumn("origin", F.lit(segment)).withColumn("home", F.col("bucket"))
        self._store(numbered, "documents", segment)
        self._store_blocks(segment, buckets)
        # a bucket whole in its task, its documents in the order they are numbered in
        said = texts.select("bucket", "id", chunks.alias("chunks"), F.transform("words", lambda w: F.lower(w)).alias("words"))
        said = said.repartition(buckets, "bucket").sortWithinPartitions("bucket", "id", "chunks").select("bucket", "words")
        self._store_postings(said.mapInArrow(_said(self.words, self.stride), MADE), segment)
        counted = self._new("postings", segment).where("documents IS NOT NULL")
        self._store_terms(counted.groupBy("term").agg(F.sum("documents").alias("frequency")), "terms", segment)
        return self._changed([*self.segments, segment], self.marks)

    def _store_postings(self, postings: DataFrame, segment: int) -> None:
        """(bucket, block, term, bits, documents), a bucket whole in its task."""
        # sorted, so that parts of a file hold narrow ranges of words
        self._store(postings.sortWithinPartitions("bucket", "term", "block"), "postings", segment)

    def _store_terms(self, terms: DataFrame, name: str, segment: int) -> None:
        self._store(terms.withColumn("bucket", F.lit(0)), name, segment)

    def delete(self, ids: DataFrame, id_column: str = "doc_id") -> SearchIndex:
        """The index without the documents of these ids; unknown and repeated ids change nothing more.

        Reads the postings of the blocks the documents lie in, and no text.
        """
        mark = _fresh()
        asked = ids.select(F.col(id_column).cast(self.id_type).alias("id")).distinct()
        going = self.documents().join(asked, "id", "left_semi").select("segment", "bucket", "id", "begin", "chunks")
        # the bits of a document in each block it reaches; one without chunks has no block
        last = F.floor((F.col("begin") + F.col("chunks") - 1) / BLOCK)
        reached = F.when(F.col("chunks") > 0, F.sequence(F.floor(F.col("begin") / BLOCK), last))
        reaching = going.select("segment", "bucket", F.explode(reached).alias("block")).distinct()
        each = self._chunks(self._table("blocks").join(reaching, ADDRESS, "left_semi")).join(going.select("segment", "bucket", "id"), ["segment", "bucket", "id"], "left_semi")
        bits = each.groupBy("segment", "bucket", "id", "block").agg(F.bit_or(_bit(F.col("slot"))).alias("bits"))
        dead = going.select("segment", "bucket", "id", F.explode_outer(reached).alias("block")).join(bits, ["segment", "bucket", "id", "block"], "left")
        dead = dead.withColumn("mark", F.lit(mark))
        dead.write.mode("append").partitionBy("segment", "bucket", "mark").parquet(f"{self.path}/dead_marks")
        marked = SearchIndex._with_marks(self, [*self.marks, mark])
        own = marked._table("dead", marks=True).where((F.col("mark") == mark) & F.col("bits").isNotNull())
        lost = self._table("postings").join(own.select(*ADDRESS, "id", F.col("bits").alias("own")), ADDRESS)
        lost = lost.where(F.col("bits").bitwiseAND(F.col("own")) != 0).select("segment", "term", "id").distinct()
        fewer = lost.groupBy("segment", "term").agg((-F.count(F.lit(1))).alias("frequency")).withColumn("bucket", F.lit(0)).withColumn("mark", F.lit(mark))
        fewer.write.mode("append").partitionBy("segment", "bucket", "mark").parquet(f"{self.path}/terms_marks")
        return self._changed(self.segments, [*self.marks, mark])

    @staticmethod
    def _with_marks(index: SearchIndex, marks: list[int]) -> SearchIndex:
        other = object.__new__(SearchIndex)
        other.__dict__.update(index.__dict__, marks=marks)
        return other

    def merge(self, most_segments: int = 1, buckets: int | None = None) -> SearchIndex:
        """The index in at most ``most_segments`` segments: the smallest ones become one, without their deleted documents.

        Postings are renumbered, texts are neither read nor written again.
        """
        sizes = self._table("documents").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()
        small = [r["segment"] for r in sorted(sizes, key=lambda r: (r["n"], r["segment"]))]
        # segments without documents have no rows
        small = sorted(set(self.segments) - set(small)) + small
        chosen = small[: len(small) - most_segments + 1]
        if len(chosen) < 2 and not (chosen and self.marks):
            return self
        segment = _fresh()
        inside = F.col("segment").isin(chosen)
        buckets = buckets or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self._bucket_count(inside))
        moved = self.documents().where(inside).select("id", "chunks", "origin", "home")
        moved = moved.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        self._store(self._numbered(moved, buckets), "documents", segment)
        self._store_blocks(segment, buckets)
        to = [F.col(a).alias(b) for a, b in (("bucket", "to"), ("block", "new_block"), ("slot", "new_slot"))]
        new = self._chunks(self._new("blocks", segment)).select("id", "chunk_no", *to)
        # an id may be dead in one of the segments and alive in another
        alive = self.documents().where(inside).select("segment", "id")
        places = self._chunks(self._table("blocks").where(inside)).join(alive, ["segment", "id"], "left_semi").join(new, ["id", "chunk_no"]).drop("id", "chunk_no")
        # an old bucket meets the new places of its chunks, which the dead have none of
        packed = "segment int, bucket int, terms array<string>, codes array<int>, blocks array<long>, bits array<long>"
        old = self._table("postings").where(inside).select("segment", "bucket", "term", "block", "bits").mapInArrow(_packed, packed)
        moved = old.groupBy("segment", "bucket").cogroup(places.groupBy("segment", "bucket")).applyInArrow(_moved, CELL)
        moved = moved.repartition(-(-buckets // MERGED_BUCKETS), "group").sortWithinPartitions("group")
        self._store_postings(moved.mapInArrow(_merged, MADE), segment)
        terms = self._frequencies(inside).where("frequency > 0")
        self._store_terms(terms, "terms", segment)
        return self._changed([s for s in self.segments if s not in chosen] + [segment], self.marks if len(chosen) < len(self.segments) else [])

    # search

    def total_documents(self) -> int:
        return max(self.documents().count(), 1)

    def _frequencies(self, which: Column | None = None) -> DataFrame:
        rows = self._table("terms").select("segment", "term", "frequency")
        rows = rows.unionByName(self._table("terms", marks=True).select("segment", "term", "frequency")) if self.marks else rows
        rows = rows if which is None else rows.where(which)
        return rows.groupBy("term").agg(F.sum("frequency").alias("frequency"))

    def idf(self, terms: DataFrame) -> DataFrame:
        """(term, document_frequency, idf) of the distinct ``term`` of a table, absent ones included."""
        total = self.total_documents()
        asked = terms.select("term").distinct()
        frequency = F.col("frequency")
        found = asked.join(self._frequencies(), "term", "left").withColumn("frequency", F.when(frequency > 0, frequency))
        present = F.log(F.lit(float(total + 1)) / (frequency + 1)) + 1.0
        return found.select(
            "term",
            F.coalesce(frequency, F.lit(0).cast("long")).alias("document_frequency"),
            F.when(frequency.isNull(), F.lit(ABSENT_IDF)).otherwise(present).alias("idf"),
        )

    def weights(self, terms: DataFrame) -> DataFrame:
        """(query_id, term, weight): a word weighs its idf over the number of the query's words; written once."""
        sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
        weighed = terms.join(self.idf(terms).select("term", "idf"), "term").join(sizes, "query_id")
        return cut_lineage(weighed.select("query_id", "term", (F.col("idf") / F.col("size")).alias("weight")))

    def top_documents(self, weights: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, segment, bucket, id, chunk_no, score): the k best documents of a query, smaller ids first.

        ``PASS_WORDS`` words of queries, about, are searched in a pass over their postings.
        """
        found = reduce(DataFrame.unionByName, [self._best_of_tasks(w, k) for w in self._passes(weights)])
        # a document may reach into blocks of several tasks
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        keys = ["query_id", "segment", "bucket", "id"]
        firsts = found.groupBy(*keys, "score").agg(F.min("chunk_no").alias("chunk_no"))
        best = firsts.groupBy(*keys).agg(F.max_by("chunk_no", "score").alias("chunk_no"), F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    @staticmethod
    def _passes(weights: DataFrame) -> list[DataFrame]:
        passes = max(1, -(-weights.count() // PASS_WORDS))
        number = F.pmod(F.xxhash64("query_id"), F.lit(passes))
        return [weights.where(number == p) for p in range(passes)]

    def _dealt(self, weights: DataFrame, keys: list[str]):
        """The queries with their words as a broadcast, and the postings of these words behind their blocks, dealt out by ``keys``."""
        # PASS_WORDS rows, about
        asked = weights.select("query_id", "term", "weight").collect()
        queries, words = sorted({r["query_id"] for r in asked}), sorted({r["term"] for r in asked})
        place, number = {q: i for i, q in enumerate(queries)}, {w: i for i, w in enumerate(words)}
        pairs = sorted((number[r["term"]], place[r["query_id"]], r["weight"]) for r in asked)
        held = self.spark.sparkContext.broadcast((queries, *(np.array(c, t) for c, t in zip(zip(*pairs) if pairs else ((), (), ()), (np.int64, np.int64, np.float64)))))
        vocabulary = self.spark.createDataFrame(list(number.items()), "term string, word int")
        postings = self._postings().join(F.broadcast(vocabulary), "term").select(*ADDRESS, "word", "bits")
        blocks = self._table("blocks").select(*ADDRESS, F.lit(-1).alias("word"), F.lit(0).cast("long").alias("bits"), "ids", "numbers")
        # the row of the block itself comes first
        rows = postings.unionByName(blocks, allowMissingColumns=True)
        # a task per bucket, at least: they hold a bounded share of the text
        tasks = max(self._bucket_count(), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return held, rows.repartition(tasks, *keys).sortWithinPartitions(*ADDRESS, "word")

    def _bucket_count(self, which: Column | None = None) -> int:
        rows = self._table("documents")
        return (rows if which is None else rows.where(which)).select("segment", "bucket").distinct().count()

    def _best_of_tasks(self, weights: DataFrame, k: int) -> DataFrame:
        """The k best documents of a query in each task."""
        held, dealt = self._dealt(weights, ADDRESS)
        query_type = weights.schema["query_id"].dataType
        schema = f"query_id {query_type.simpleString()}, segment int, bucket int, id {self.id_type}, chunk_no int, score double"
        types = [to_arrow_type(t) for t in (query_type, IntegerType(), IntegerType(), dealt.schema["ids"].dataType.elementType, IntegerType(), DoubleType())]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, *pairs = held.value
            best = _Best(len(queries), k, *pairs)
            for block in _whole_blocks(batches):
                best.see(*block)
            if len(best.query):
                names = ["query_id", "segment", "bucket", "id", "chunk_no", "score"]
                ids = pa.array([queries[q] for q in best.query.tolist()])
                rest = [pa.array(a.tolist()) for a in (best.segment, best.bucket, best.id, best.number, best.score)]
                columns = [c.cast(t) for c, t in zip([ids, *rest], types)]
                yield pa.RecordBatch.from_arrays(columns, names)

        return dealt.mapInArrow(task, schema)

    def chunk_scores(self, weights: DataFrame) -> DataFrame:
        """(query_id, id, chunk_no, score) of every chunk that shares a word with a query.

        Rows that share an id add up, chunk by chunk.
        """
        rows = self._of_blocks(weights, ADDRESS, _every_chunk)
        repeated = self.documents().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        if repeated.isEmpty():
            return rows
        several = rows.join(repeated, "id", "left_semi").groupBy("query_id", "id", "chunk_no")
        added = rows.join(repeated, "id", "left_anti").unionByName(several.agg(_rounded(F.sum("score")).alias("score")))
        return added.select(*rows.columns)

    def best_chunks(self, weights: DataFrame) -> DataFrame:
        """(query_id, id, chunk_no, score): the first chunk with the highest score of every document that shares a word with a query.

        The blocks of a bucket meet in one task in their order, so a document that reaches over several is known whole there.
        """
        return self._of_blocks(weights, ADDRESS[:2], _best_of_documents)

    def _of_blocks(self, weights: DataFrame, keys: list[str], read) -> DataFrame:
        parts = [self._scored(w, keys, read) for w in self._passes(weights)]
        return reduce(DataFrame.unionByName, parts)

    def _scored(self, weights: DataFrame, keys: list[str], read) -> DataFrame:
        """What ``read`` makes of the blocks with words of queries; they are scored where they lie, and no score is shuffled."""
        held, dealt = self._dealt(weights, keys)
        query_type, id_type = weights.schema["query_id"].dataType, dealt.schema["ids"].dataType.elementType
        schema = f"query_id {query_type.simpleString()}, id {self.id_type}, chunk_no int, score double"
        types = [to_arrow_type(t) for t in (query_type, id_type)]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, *pairs = held.value
            names = pa.array(queries, types[0])
            for query, ids, number, score in read(_whole_blocks(batches), pairs, len(queries)):
                columns = [names.take(pa.array(query)), pa.array(ids, types[1]), pa.array(number, pa.int32()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "chunk_no", "score"])

        return dealt.mapInArrow(task, schema)

    def first_documents(self, k: int) -> DataFrame:
        """(segment, bucket, id) of the k smallest ids that have words."""
        return self.documents().where("chunks > 0").select("segment", "bucket", "id").orderBy("id").limit(k)

    def passages(self, hits: DataFrame) -> DataFrame:
        """``hits`` (segment, bucket, id, chunk_no, ...) with their ``text``: only the buckets they lie in are read."""
        where = self._table("documents").select("segment", "bucket", "id", "origin", "home")
        # k rows per query: counted, and few unless there are very many queries
        few = F.broadcast if hits.count() <= MOST_HITS else lambda rows: rows
        placed = where.join(few(hits), ["segment", "bucket", "id"]).drop("segment", "bucket")
        # texts stay in the segment they came with, merged or not
        columns = f"{TABLES['texts'].format(id=self.id_type)}, segment int, bucket int"
        stored = self.spark.read.schema(columns).parquet(f"{self.path}/texts") if self.segments else self.spark.createDataFrame([], columns)
        stored = stored.select("id", "words", F.col("segment").alias("origin"), F.col("bucket").alias("home"))
        text = F.array_join(F.slice("words", F.col("chunk_no") * self.stride + 1, self.words), " ")
        return stored.join(few(placed), ["origin", "home", "id"]).withColumn("text", text).drop("origin", "home", "words")


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of a column, which arrive one after another."""
    last, held = None, []
    for batch in batches:
        values = batch.column(key).to_numpy()
        edges = np.flatnonzero(np.diff(values)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(values)]):
            if a == b:
                continue
            if held and values[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _listed(rows: pa.Table, name: str) -> pa.Array:
    """The lists of a column one after another."""
    return pa.concat_arrays([c.flatten() for c in rows.column(name).chunks])


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return _listed(rows, name).to_numpy().astype(np.int64)


def _lengths(rows: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(rows.column(name)), 0).to_numpy().astype(np.int64)


def _coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and the number of each word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _postings(vocabulary: pa.Array, bucket: np.ndarray, code: np.ndarray, block: np.ndarray, slot: np.ndarray, documents: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The postings of words (numbers in ``vocabulary``) in slots of blocks, by bucket, word and block."""
    if not len(code):
        return
    order = pc.sort_indices(vocabulary).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    blocks = int(block.max()) + 1
    key = (bucket * len(order) + rank[code]) * blocks + block
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), slot.astype(np.uint64))[by], first).view(np.int64)
    word = key[first] // blocks
    number = order[word % len(order)]
    counts = np.zeros(len(order), np.int64) if documents is None else documents
    untold = np.diff(word, prepend=-1) == 0 if documents is not None else np.ones(len(word), bool)
    columns = [
        pa.array(word // len(order), pa.int32()), pa.array(key[first] % blocks), vocabulary.take(pa.array(number)),
        pa.array(bits), pa.array(counts[number], pa.int64(), mask=untold),
    ]
    made = pa.RecordBatch.from_arrays(columns, ["bucket", "block", "term", "bits", "documents"])
    for at in range(0, made.num_rows, 1 << 16):
        yield made.slice(at, 1 << 16)


def _said(size: int, stride: int):
    """Task: the postings of the words of texts, which arrive bucket by bucket in the order of their documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "bucket"):
            vocabulary, code = _coded(_listed(rows, "words"))
            count = _lengths(rows, "words")
            chunks = -(-count // stride)
            begin = np.cumsum(chunks) - chunks
            document, position = np.repeat(np.arange(len(count)), count), _steps(count)
            # a word stands in all chunks that began less than their size before it
            first = np.maximum(0, -((size - 1 - position) // stride))
            many = position // stride - first + 1
            of = np.repeat(np.arange(len(code)), many)
            at = begin[document[of]] + first[of] + _steps(many)
            pairs = np.sort(code * len(count) + document)
            held = pairs[np.diff(pairs, prepend=-1) != 0] // max(1, len(count))
            bucket = np.full(len(of), rows.column("bucket")[0].as_py())
            yield from _postings(vocabulary, bucket, code[of], at // BLOCK, at % BLOCK, np.bincount(held, minlength=len(vocabulary)))

    return task


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: postings as a row for each stretch of one bucket: its words, and of each posting the word's number, the block and the bits."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ADDRESS[:2]], 1)
        edges = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(keys)]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            coded = part.column("term").dictionary_encode()
            lists = [coded.dictionary, coded.indices.cast(pa.int32()), part.column("block"), part.column("bits")]
            columns = [part.column(c).slice(0, 1) for c in ADDRESS[:2]] + [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in lists]
            yield pa.RecordBatch.from_arrays(columns, [*ADDRESS[:2], "terms", "codes", "blocks", "bits"])


def _moved(old: pa.Table, places: pa.Table) -> pa.Table:
    """Grouped task: the postings of an old bucket at their new places: for each group of new buckets its words, how often each comes, and where."""
    kinds = dict(zip(("group", "terms", "sizes", "buckets", "blocks", "slots"), (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int8())))
    if not old.num_rows or not places.num_rows:
        return pa.schema([(n, k if n == "group" else pa.list_(k)) for n, k in kinds.items()]).empty_table()
    vocabulary, number = _coded(_listed(old, "terms"))
    terms = _lengths(old, "terms")
    code = number[np.repeat(np.cumsum(terms) - terms, _lengths(old, "codes")) + _numbers(old, "codes")]
    bits = _numbers(old, "bits").astype("<i8")
    stands = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    posting = stands // BLOCK
    at = _numbers(old, "blocks")[posting] * BLOCK + stands % BLOCK
    moves = {c: places.column(c).to_numpy().astype(np.int64) for c in ("block", "slot", "to", "new_block", "new_slot")}
    own = moves["block"] * BLOCK + moves["slot"]
    by = np.argsort(own)
    low, high = np.searchsorted(own[by], at, "left"), np.searchsorted(own[by], at, "right")
    move = by[np.repeat(low, high - low) + _steps(high - low)]
    code = np.repeat(code[posting], high - low)
    group = moves["to"][move] // MERGED_BUCKETS
    order = np.argsort(group * len(vocabulary) + code)
    move, group, code = move[order], group[order], code[order]
    new = np.diff(group, prepend=-1) != 0
    first = np.flatnonzero(new | (np.diff(code, prepend=-1) != 0))
    edges = np.append(np.flatnonzero(new), len(group))
    listed = {"terms": vocabulary.take(pa.array(code[first])), "sizes": np.diff(np.append(first, len(code))), "buckets": moves["to"][move], "blocks": moves["new_block"][move], "slots": moves["new_slot"][move]}
    columns = {"group": pa.array(group[edges[:-1]], pa.int32())}
    for name, values in listed.items():
        offsets = np.searchsorted(first, edges) if name in ("terms", "sizes") else edges
        columns[name] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kinds[name]) if name != "terms" else values)
    return pa.table(columns)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the postings of new buckets from what old ones moved there, which arrives group by group."""
    for rows in _by_key(batches, "group"):
        vocabulary, code = _coded(_listed(rows, "terms"))
        yield from _postings(vocabulary, _numbers(rows, "buckets"), np.repeat(code, _numbers(rows, "sizes")), _numbers(rows, "blocks"), _numbers(rows, "slots"))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(segment, bucket, ids, numbers, words, bits) of every block that holds words of a query, from rows sorted by block."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        keys = np.stack([table.column(c).to_numpy() for c in ADDRESS], 1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else np.empty(0, np.int64)
        bounds = np.concatenate([[0], edges]).tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield from _block(table.slice(a, b - a))
        rest = table.slice(bounds[-1]) if len(keys) else None
    if rest is not None:
        yield from _block(rest)


def _block(rows: pa.Table) -> Iterator[tuple]:
    if len(rows) > 1:
        first = {c: rows.column(c)[0].as_py() for c in ("segment", "bucket", "ids", "numbers")}
        yield (*first.values(), rows.column("word").to_numpy()[1:], rows.column("bits").to_numpy()[1:])


def _matched(of_word: np.ndarray, words: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of words and queries that a block meets, with the bits of their words."""
    low, high = np.searchsorted(of_word, words, "left"), np.searchsorted(of_word, words, "right")
    count = high - low
    return np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum()), np.repeat(bits, count)


def _summed(query: np.ndarray, weight: np.ndarray, held: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The queries that occur, and a row of scores by slot for each."""
    order = np.argsort(query, kind="stable")
    query, weight, held = query[order], weight[order], held[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    stands = (held[:, None] >> np.arange(slots)) & 1
    unit = float(10**SCORE_DIGITS)
    return query[first], np.floor(np.add.reduceat(weight[:, None] * stands, first) * unit + 0.5) / unit


def _block_scores(blocks: Iterator[tuple], pairs: list[np.ndarray]) -> Iterator[tuple]:
    """(segment, bucket, ids, numbers, queries, scores) of the blocks."""
    of_word, of_query, weight = pairs
    for segment, bucket, ids, numbers, words, bits in blocks:
        pair, held = _matched(of_word, words, bits)
        yield segment, bucket, ids, np.array(numbers), *_summed(of_query[pair], weight[pair], held, len(ids))


def _every_chunk(blocks: Iterator[tuple], pairs: list[np.ndarray], queries: int) -> Iterator[tuple]:
    """(query, id, number, score) of every chunk with a word of a query, block by block."""
    for _, _, ids, numbers, query, score in _block_scores(blocks, pairs):
        row, slot = np.nonzero(score > 0)
        yield query[row], [ids[s] for s in slot.tolist()], numbers[slot], score[row, slot]


def _best_of_documents(blocks: Iterator[tuple], pairs: list[np.ndarray], queries: int) -> Iterator[tuple]:
    """(query, id, number, score) of the best chunk of every document; blocks of a bucket come in their order."""
    last = None
    far = np.iinfo(np.int64).max

    def finished(name, best, number):
        query = np.flatnonzero(best > 0)
        return query, [name] * len(query), number[query], best[query]

    for segment, bucket, ids, numbers, query, score in _block_scores(blocks, pairs):
        # the chunks of a document stand side by side
        starts = [0] + [s for s in range(1, len(ids)) if ids[s] != ids[s - 1]]
        run = np.repeat(np.arange(len(starts)), np.diff([*starts, len(ids)]))
        top = np.maximum.reduceat(score, starts, axis=1)
        first = np.minimum.reduceat(np.where(score == top[:, run], numbers, far), starts, axis=1)
        begun = (segment, bucket, ids[0])
        if last is not None and last[0] == begun:
            # it came in the block before: an equal score counts where its chunk is the first
            _, best, number = last
            better = (top[:, 0] > best[query]) | ((top[:, 0] == best[query]) & (first[:, 0] < number[query]))
            top[:, 0], first[:, 0] = np.where(better, top[:, 0], best[query]), np.where(better, first[:, 0], number[query])
            absent = np.ones(queries, bool)
            absent[query] = False
            if len(starts) > 1:
                yield finished(ids[0], np.where(absent, best, 0.0), number)
            else:
                best, number = best.copy(), number.copy()
                best[query], number[query] = top[:, 0], first[:, 0]
                last = (begun, best, number)
                continue
        elif last is not None:
            yield finished(last[0][2], *last[1:])
        # the last document may reach into the next block
        best, number = np.zeros(queries), np.full(queries, far)
        best[query], number[query] = top[:, -1], first[:, -1]
        last = ((segment, bucket, ids[-1]), best, number)
        row, place = np.nonzero(top[:, :-1] > 0)
        yield query[row], [ids[starts[p]] for p in place.tolist()], first[row, place], top[row, place]
    if last is not None:
        yield finished(last[0][2], *last[1:])


class _Best:
    """The k best documents of each query among the blocks seen so far."""

    def __init__(self, queries: int, k: int, word: np.ndarray, query: np.ndarray, weight: np.ndarray):
        """Pairs of words and queries, sorted by word."""
        self.k, self.of_word, self.of_query, self.weight = k, word, query, weight
        #: what a chunk has to reach, by query
        self.least = np.zeros(queries)
        none = np.empty(0, np.int64)
        self.query, self.segment, self.bucket, self.id, self.number, self.score = none, none, none, none, none, np.empty(0)

    def see(self, segment: int, bucket: int, ids: list, numbers: list[int], words: np.ndarray, bits: np.ndarray) -> None:
        pair, held = _matched(self.of_word, words, bits)
        query, weight = self.of_query[pair], self.weight[pair]
        # two rounding steps
        slack = 2.0 / 10**SCORE_DIGITS
        bound = np.bincount(query, weight, len(self.least))
        reached = bound[query] >= self.least[query] - slack
        if not reached.any():
            return
        query, score = _summed(query[reached], weight[reached], held[reached], len(ids))
        row, slot = np.nonzero((score > 0) & (score >= self.least[query][:, None]))
        if not len(row):
            return
        ids, numbers = np.array(ids), np.array(numbers)
        same = lambda value: np.full(len(row), value)
        own = (query[row], same(segment), same(bucket), ids[slot], numbers[slot], score[row, slot])
        if len(self.query):
            own = [np.concatenate(pair) for pair in zip((self.query, self.segment, self.bucket, self.id, self.number, self.score), own)]
        self._keep(*own)

    def _keep(self, query, segment, bucket, name, number, score) -> None:
        """One chunk per document, the first of the best, and k documents per query."""
        code = np.unique(name, return_inverse=True)[1] if name.dtype.kind not in "iu" else name
        order = np.lexsort((number, -score, code, query))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(query[order]) != 0) | (np.diff(code[order]) != 0)
        order = order[new]
        order = order[np.lexsort((code[order], -score[order], query[order]))]
        own = query[order]
        first = np.searchsorted(own, own, "left")
        order = order[np.arange(len(own)) - first < self.k]
        self.query, self.segment, self.bucket, self.id, self.number, self.score = (c[order] for c in (query, segment, bucket, name, number, score))
        full = np.bincount(self.query, minlength=len(self.least)) >= self.k
        last = np.searchsorted(self.query, np.flatnonzero(full), "right") - 1
        self.least[full] = self.score[last]
