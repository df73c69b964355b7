"""Personal data: strict patterns as seeds, and contexts learned from them that find more; built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
#: The strict forms. Possessive, and begun only where a run of their first characters begins or where the
#: last match ended, they match what the plain forms match, in time proportional to the text.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
END = r"(?![\p{L}\p{N}@])"
#: What may be an identifier of a kind if its context says so: runs of their own characters, after a blank or any other sign.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+@\])-])[A-Za-z0-9._%+-]++(?:@|\[at\]|\(at\))[A-Za-z0-9-]++(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9-]++)*+" + END,
    "ip": r"(?<![\p{L}\p{N}:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}" + END,
    "card": r"(?<![\p{L}\p{N}+.,_-])[0-9](?:[\x20-]?[0-9]){11,18}+" + END,
    "phone": r"(?<![\p{L}\p{N}+.,_-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}+" + END,
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _matches(text: Column, pattern: str) -> Column:
    """All matches in order, each with what stands before and after it.

    Matches and the gaps between them come from the same pattern, so gap k
    stands before match k and gap k + 1 behind it. Of a gap the length and both
    ends are kept.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(
        F.split(text, pattern, -1),
        lambda g: F.struct(F.length(g).alias("n"), F.substring(g, -64, 64).alias("tail"), F.substring(g, 1, 64).alias("head")),
    )
    return F.struct(found.alias("found"), gaps.alias("gaps"))


def _valid(kind: Column, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", text.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(kind == "card", F.when(n.between(16, 19), F.call_function("luhn_check", digits)).otherwise(False))
        .otherwise(n.between(8, 15))
    )


def scan(docs: DataFrame) -> DataFrame:
    """``row`` and ``doc_id`` of every document with all strict and loose matches; no text is kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    searched = [
        F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), _matches(F.col("text"), forms[kind]).alias("m"))
        for strict, forms in ((True, STRICT), (False, LOOSE))
        for kind in KINDS
    ]
    # every form has a digit or an @
    hits = F.when(F.col("text").rlike("[0-9@]|[(\\[]at[)\\]]"), F.array(*searched))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.filter(hits, lambda h: F.size(h["m"]["found"]) > 0).alias("hits")))


def matches(scanned: DataFrame) -> DataFrame:
    """One row per match with its place in code points (end exclusive) and its contexts; strict ones only if valid."""
    one = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.kind", "h.strict", "h.m.found", "h.m.gaps")
    count = F.size("found")
    zipped = F.arrays_zip(F.col("found").alias("text"), F.slice("gaps", F.lit(1), count).alias("before"), F.slice("gaps", F.lit(2), count).alias("after"))
    each = one.select("row", "kind", "strict", F.posexplode(zipped).alias("nth", "z")).select("row", "kind", "strict", "nth", "z.*")
    own = W.partitionBy("row", "kind", "strict").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    each = each.withColumn("end", F.sum(F.col("before.n") + F.length("text")).over(own)).withColumn("start", F.col("end") - F.length("text"))
    tail, head = F.lower("before.tail"), F.lower("after.head")
    words = F.split(F.trim(tail), r"\s+")
    each = each.withColumn("l1", F.element_at(words, -1)).withColumn("l2", F.when(F.size(words) > 1, F.element_at(words, -2)).otherwise(F.lit("")))
    each = each.withColumn("r1", F.element_at(F.split(F.trim(head), r"\s+"), 1))
    # the last letters before it, and the signs between them and it
    each = each.withColumn("label", F.regexp_extract(tail, r"(\p{L}+)[^\p{L}]{0,8}$", 1))
    signs = F.regexp_replace(F.regexp_extract(tail, r"\p{L}([^\p{L}]{0,8})$", 1), r"\s+", "")
    each = each.withColumn("signs", F.concat(signs, F.lit("_"), F.regexp_extract(head, r"^[^\p{L}\p{N}\s]", 0)))
    return each.where(~F.col("strict") | _valid(F.col("kind"), F.col("text"))).drop("before", "after", "nth")


def _apart(spans: DataFrame) -> DataFrame:
    """Loose matches that touch no strict one."""
    order = W.partitionBy("row").orderBy("start", F.desc("strict"))
    before = F.max(F.when(F.col("strict"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(F.col("strict"), F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return spans.withColumn("free", free).where(F.col("strict") | F.col("free")).drop("free")


def _patterns() -> Column:
    """The contexts of a match: the word before, two words before, the words on both sides, the last letters before it, and those with the signs around it."""
    l1, l2, r1, label = F.col("l1"), F.col("l2"), F.col("r1"), F.col("label")
    # signs alone are no context
    spoken = F.when(l1.rlike(r"[\p{L}\p{N}]"), l1)
    worded = F.array(F.concat(spoken, F.lit(" _")), F.concat_ws(" ", l2, l1, F.lit("_")), F.concat(spoken, F.lit(" _ "), r1))
    shaped = F.array(F.concat(label, F.lit("~_")), F.concat(label, F.lit("~"), F.col("signs")))
    return F.array_distinct(F.array_compact(F.when(label != "", F.concat(worded, shaped)).otherwise(worded)))


def _wrong() -> Column:
    """Loose matches that have the full form of their kind and fail its check."""
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    return ~F.col("strict") & (F.col("kind") == "card") & digits.between(16, 19)


def learned(spans: DataFrame, least_seeds: float = 3.0, least_pattern: float = 0.7, least_instance: float = 0.9, unknown_wrong: float = 0.25) -> DataFrame:
    """Loose matches that high-confidence contexts name, with the strict ones as seeds.

    The graph has an edge between a context and each distinct value seen in
    it. A strict value is sure, one that fails the check of its full form is
    wrong, all others are unknown. A context's confidence for a kind is the
    share of its values that are sure, if they add up to ``least_seeds``: the
    sure part of each, over that, all that is wrong, ``unknown_wrong`` of what is
    unknown, and one. A value that is not strict is as sure as that at least one of
    its contexts of ``least_pattern`` or more is right, in thousandths. Scores
    only rise, and the rounds end when none does. Then a match is taken if its
    value reaches ``least_instance`` and it stands in such a context itself.
    """
    seen = cut_lineage(spans.withColumn("wrong", _wrong()).withColumn("pattern", F.explode(_patterns())).select("row", "kind", "strict", "wrong", "text", "start", "end", "pattern"))
    edges = cut_lineage(seen.groupBy("kind", "pattern", "text").agg(F.max("strict").alias("strict"), F.min("wrong").alias("wrong")))
    # contexts that hold no unknown value decide nothing
    useful = edges.where("not strict and not wrong").select("kind", "pattern").distinct()
    edges = cut_lineage(edges.join(useful, ["kind", "pattern"], "left_semi").withColumn("sure", F.when(F.col("strict"), 1000).otherwise(0).cast("long")))
    reached = None
    while True:
        sure = F.sum("sure") / 1000
        against = F.sum(F.when(F.col("wrong"), F.lit(1000.0)).otherwise((1000 - F.col("sure")) * unknown_wrong)) / 1000
        scored = edges.groupBy("kind", "pattern").agg(F.when(sure >= least_seeds, sure / (sure + against + 1)).otherwise(0.0).alias("trust"))
        scored = cut_lineage(scored.where(F.col("trust") >= least_pattern))
        doubt = F.exp(F.sum(F.log1p(-F.col("trust"))))
        known = edges.where("not strict and not wrong").join(scored, ["kind", "pattern"]).groupBy("kind", "text").agg(F.floor(1000 * (1 - doubt)).cast("long").alias("found"))
        known = cut_lineage(known)
        now = known.agg(F.sum("found")).first()[0] or 0
        if now == reached:
            break
        reached = now
        edges = edges.drop("sure").join(known, ["kind", "text"], "left")
        edges = cut_lineage(edges.withColumn("sure", F.when(F.col("strict"), 1000).otherwise(F.coalesce("found", F.lit(0))).cast("long")).drop("found"))
    taken = known.where(F.col("found") >= 1000 * least_instance).select("kind", "text")
    named = seen.where("not strict and not wrong").join(scored.select("kind", "pattern"), ["kind", "pattern"], "left_semi").join(taken, ["kind", "text"], "left_semi")
    return named.select("row", "kind", "start", "end").distinct()


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, strict; by kind as listed, then start) of every row of ``docs``.

    Reads ``doc_id`` and ``text`` only; a null text is empty. Strict spans are
    the valid matches of each kind on its own, leftmost first; a match that
    fails its check is dropped and its characters are not tried again. Spans
    that contexts add touch no strict span; of added ones that overlap, the one
    that begins first stays, of equal ones the first kind. Rows that share or
    lack a ``doc_id`` give a row each. An empty table gives an empty result.
    """
    scanned = scan(docs)
    found = cut_lineage(_apart(matches(scanned)))
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    added = learned(found, **options).withColumn("rank", rank)
    order = W.partitionBy("row").orderBy("start", "rank", F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    added = added.withColumn("reach", F.coalesce(F.max("end").over(order), F.lit(0))).where(F.col("reach") <= F.col("start")).drop("reach")
    spans = found.where("strict").withColumn("rank", rank).select("row", "rank", "kind", "start", "end", "strict")
    spans = spans.union(added.select("row", "rank", "kind", "start", "end", F.lit(False)))
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "end", "kind", "strict"))).alias("spans"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,strict:boolean>>")
    plain = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strict"].alias("strict")))
    return scanned.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce(plain, empty).alias("spans"))
