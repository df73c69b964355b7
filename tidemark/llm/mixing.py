"""Mixing sources to target weights by a low-discrepancy schedule; built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Points of the schedule have so many binary digits; a range of points is looked up by the leading ones.
DIGITS, CELL_DIGITS = 40, 12
ONE = 1 << DIGITS


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``size`` (words of the whole text, null: 0) of every row."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """One row per source: ``sid``, ``source``, ``source_size``, ``target`` and its range of points.

    Sources by code point, null last, weigh as ``weights`` say, repeating. All
    words are shared by weight; a target stops at ``most_copies`` times its
    source's size and the excess goes to the others by weight. In order of
    size per weight the sources that stop come first, so running sums find
    them. The table has a row per source, which is all that its windows sort.
    """
    every = W.orderBy(F.col("source").isNull(), "source")
    source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(every) - 1)
    source = source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    source = source.withColumn("cap", most_copies * F.col("source_size"))
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    source = source.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level holds for the first source that does not stop, and for all after it
    source = source.withColumn("level", F.max(F.when(~F.col("stops"), F.col("level"))).over(whole))
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    source = source.withColumn("target", target)
    up_to = F.try_divide(F.sum("target").over(W.orderBy("sid")), F.sum("target").over(whole))
    hi = F.when(F.col("sid") == F.max("sid").over(whole), F.lit(ONE)).otherwise(F.floor(F.coalesce(up_to, F.lit(0.0)) * ONE))
    source = source.withColumn("hi", F.least(hi, F.lit(ONE)).cast("long"))
    source = source.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("sid")), F.lit(0).cast("long")))
    return source.select("sid", "source", "source_size", "target", F.round("target").cast("long").alias("quota"), "lo", "hi")


def _reversed(value: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(value), DIGITS, "0")), 2, 10).cast("long")


def _points_below(n: Column, bound: Column, turned: Column) -> Column:
    """How many of the first ``n`` van der Corput points lie below ``bound``; ``turned`` has its digits reversed.

    The bound is a sum of intervals of length 2^-p, one for each digit p that
    is set. The points in such an interval are those whose number has one
    certain remainder modulo 2^p.
    """

    def width(p: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), p)

    def inside(p: Column) -> Column:
        rest = turned.bitwiseAND(width(p - 1) - 1)
        return F.when(turned.bitwiseAND(width(p - 1)) == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", n + width(p) - 1 - rest, p))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(DIGITS)), F.lit(0).cast("long"), lambda s, p: s + inside(p))
    return F.when(bound >= ONE, n).otherwise(total)


def _rank(n: Column) -> Column:
    """How many of the first ``n`` points lie in the source's own range."""
    return _points_below(n, F.col("hi"), F.col("hi_turned")) - _points_below(n, F.col("lo"), F.col("lo_turned"))


def _places(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Every row with its ``start`` in the shuffled words of its source.

    The order is by md5 of seed and ``doc_id``. Running sums are taken over
    buckets of leading hex digits first, then inside them: for n rows of one
    source both have about the root of n rows.
    """
    digits = max(1, math.ceil(math.log(max(1, sized.count()), 16) / 2))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # sources are few: a null name meets the null row of the source table
    rows = sized.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = cut_lineage(rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits)))
    inside = W.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size")
    upto = inside.rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("nth", F.row_number().over(inside)).withColumn("start", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    placed = placed.join(sums.drop("words"), ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("base"))
    return placed.drop("base", "key")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """``slot``, ``sid`` and the slot's ``rank`` among those of its source.

    Slot i goes to the source whose range of cumulative weight holds the i-th
    van der Corput point, so every stretch of the schedule has the sources in
    their weights. A source whose share is less than one slot gets one at the end.
    """
    spark = sources.sparkSession
    cell = DIGITS - CELL_DIGITS
    ranges = sources.where("lo < hi").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", cell), F.shiftright(F.col("hi") - 1, cell))))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", _reversed(F.col("slot")))
    points = points.withColumn("cell", F.shiftright("point", cell))
    placed = points.join(ranges, "cell").where("lo <= point and point < hi").select("slot", "sid", _rank(F.col("slot")).alias("rank"))
    extra = sources.where("slots > 0 and given = 0").select((F.lit(slots) + F.col("sid")).cast("long").alias("slot"), "sid", F.lit(0).cast("long").alias("rank"))
    return placed.union(extra)


def mixture(docs: DataFrame, block_words: int = 256, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix, and the rows of ``docs`` with their place in it.

    Reads ``doc_id``, ``source`` and ``text`` only. The first table has the
    pieces of the mix: ``slot``, ``block``, the row (``sid``, ``bucket``,
    ``nth``), ``copy``, ``from_word`` and ``words``. The second has a row for
    every row of ``docs``: the same key, ``doc_id``, ``size``, ``source``,
    ``source_size``, ``target``. A slot holds ``block_words`` words of any source, and
    the schedule alone says how many slots a source has: its rows, in shuffled
    order and as often as they are needed, are cut into blocks of that size,
    and block k goes to the k-th slot of the source. What a source gives is
    within a few blocks of its target, as the points of the schedule are
    spread, and never above ``most_copies`` times its size (its last slots then
    stay empty). A target of less than one block is one shorter block. Rows that are equal in
    all columns take neighbouring places; which of them comes first does not
    matter. Null ``doc_id`` is ordered as an empty one. Texts without words
    take no place. An empty table, or one without any words, gives an empty mix.
    """
    sized = cut_lineage(sizes(docs))
    source = cut_lineage(targets(sized, weights, most_copies))
    total = source.agg(F.sum("source_size")).first()[0] or 0
    slots = math.ceil(total / block_words)
    source = source.withColumn("lo_turned", _reversed(F.col("lo"))).withColumn("hi_turned", _reversed(F.col("hi")))
    source = source.withColumn("given", _rank(F.lit(slots).cast("long")))
    source = source.withColumn("slots", F.when(F.col("quota") > 0, F.greatest("given", F.lit(1))).otherwise(0))
    filled = F.least(F.col("slots") * block_words, most_copies * F.col("source_size"))
    source = cut_lineage(source.withColumn("words", F.when(F.col("quota") < block_words, F.col("quota")).otherwise(filled)))
    placed = cut_lineage(_places(sized, source, seed))

    def block_of(word: Column) -> Column:
        return F.call_function("div", word, F.lit(block_words))

    # words [at, to) of the endless row of copies
    copies = placed.where("size > 0").withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(most_copies)])))
    copies = copies.withColumn("at", F.col("copy") * F.col("source_size") + F.col("start")).where("at < words")
    copies = copies.withColumn("to", F.least(F.col("at") + F.col("size"), F.col("words")))
    pieces = copies.withColumn("block", F.explode(F.sequence(block_of(F.col("at")), block_of(F.col("to") - 1))))
    first = F.greatest(F.col("block") * block_words, F.col("at"))
    last = F.least((F.col("block") + 1) * block_words, F.col("to"))
    pieces = pieces.select("sid", "bucket", "nth", "copy", "block", (first - F.col("at")).alias("from_word"), (last - first).alias("words"))
    planned = schedule(source, slots).withColumnRenamed("rank", "block")
    return pieces.join(planned, ["sid", "block"]), placed.drop("lo", "hi", "lo_turned", "hi_turned", "given", "slots", "quota", "words", "start")


def _taken(docs: DataFrame, most_copies: int, options: dict) -> DataFrame:
    """Rows with ``taken`` and ``slots``: for every copy the first slot that holds words of it."""
    mix, rows = mixture(docs, most_copies=most_copies, **options)
    key = ["sid", "bucket", "nth"]
    firsts = F.array(*[F.min(F.when(F.col("copy") == i, F.col("slot"))) for i in range(most_copies)])
    return rows.join(mix.groupBy(*key).agg(F.sum("words").alias("taken"), firsts.alias("slots")), key, "left")


def taken_words(docs: DataFrame, most_copies: int = 3, **options) -> DataFrame:
    """``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``taken`` and ``first_slot`` per row.

    ``taken`` are the words in the mix, copies counted. ``first_slot`` is the
    first slot of the schedule that holds words of the row (null if none does):
    in its order the rows come in the weights of their sources from the start.
    """
    first = F.array_min("slots").alias("first_slot")
    return _taken(docs, most_copies, options).select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), first)


def mix_documents(docs: DataFrame, most_copies: int = 3, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in whole copies and in order of the schedule; columns unchanged.

    A document of which the mix takes a part goes in whole if at least half of
    it is taken, so what a source gives changes by less than one document. Each
    copy stands where the first of its slots does. Texts without words are in
    no block; they stay once, at the end. Rows that share a ``doc_id`` get the
    copies of all of them, shared out by size, at the first slots of any.
    """
    slots = [F.min(F.get("slots", F.lit(i))) for i in range(most_copies)]
    kept = _taken(docs, most_copies, options).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.array(*slots).alias("slots"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.coalesce("taken", F.lit(0)) / F.col("size"))).cast("int")
    kept = kept.withColumn("copies", copies).where("copies > 0").select(F.col("doc_id").alias("mixed_id"), F.posexplode(F.slice("slots", F.lit(1), F.col("copies"))).alias("copy", "slot"))
    kept = cut_lineage(kept.select("mixed_id", "slot"))
    mixed = docs.join(kept.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(kept["mixed_id"]))
    return mixed.orderBy(kept["slot"].asc_nulls_last(), kept["mixed_id"]).select(*[docs[c] for c in docs.columns])
