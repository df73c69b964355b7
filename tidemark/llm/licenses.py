"""License notices: word k-grams vote for diagonals of template and text; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Between words: every ASCII character but digits and lower-case letters, after lower-casing A-Z.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Templates of more characters than this together are joined by shuffle, not broadcast.
BROADCAST_CHARACTERS = 4 << 20

# Phrases that must stand word for word, and the labels they give.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# The usual notices of public licenses.
NOTICES = [
    ("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-3", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def cut_words(df: DataFrame) -> DataFrame:
    """``text`` replaced by ``words``, the array of its words; a null text has none."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    # Spark lower-cases other letters too, and translates slowly
    lowered = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    cut = df.withColumn("words", F.split(lowered, SEPARATOR, -1)).drop("text")
    # a separator at either end leaves an empty string there
    lead = (F.element_at("words", 1) == "").cast("int")
    tail = (F.element_at("words", -1) == "").cast("int")
    return cut.withColumn("words", F.slice("words", lead + 1, F.greatest(F.size("words") - lead - tail, F.lit(0))))


def _gram(k: int) -> list[Column]:
    """The k words from place ``pos`` on; null past the end."""
    return [F.get("words", F.col("pos") + i) for i in range(k)]


def templates(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """``template`` (a number), ``label``, ``exact``, ``words`` and ``size`` of all phrases and notices."""
    rows = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in notices]
    listed = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(exact).alias("exact")) for i, (label, text, exact) in enumerate(rows)]
    return cut_words(spark.range(1).select(F.inline(F.array(*listed)))).withColumn("size", F.size("words"))


def votes(docs: DataFrame, listed: DataFrame, k: int, small: bool) -> DataFrame:
    """``row``, ``doc_id`` and ``n_words`` of every document, with ``template``, ``place`` in it and ``pos`` for each k-gram both share.

    K-grams are joined by hash and compared word for word. Documents without
    a vote have one row with nulls.
    """
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    spoken = F.concat_ws("\n", *_gram(k))
    known = listed.select("template", "words", F.posexplode("words").alias("pos", "word")).where(F.col("pos") <= F.size("words") - k)
    known = known.select("template", F.col("pos").alias("place"), F.xxhash64(*_gram(k)).alias("hash"), spoken.alias("spoken"))
    each = cut_words(named).select("row", "doc_id", F.size("words").alias("n_words"), "words", F.posexplode_outer("words").alias("pos", "word"))
    # a gram past the end has fewer words and equals none
    same = (F.xxhash64(*_gram(k)) == F.col("hash")) & (spoken == F.col("spoken"))
    met = each.join(F.broadcast(known) if small else known, same, "left").where(F.col("template").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    return cut_lineage(met.select("row", "doc_id", "n_words", "template", "place", F.col("pos").cast("long").alias("pos")))


def spans(votes: DataFrame, listed: DataFrame, k: int, drift: int) -> DataFrame:
    """``row``, ``template``, ``start``, ``end`` and ``share`` of the stretches whose votes lie on neighbouring diagonals.

    Diagonals at most ``drift`` words apart are one stretch. ``share`` is the
    number of words of the template that votes cover, over the words of the
    template or of the stretch, whichever are more.
    """
    diagonals = votes.groupBy("row", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        # as many as the template has words, at most
        F.collect_list("place").alias("places"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"),
    )
    order = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(False))
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("stretch", F.sum("apart").over(order))
    inner = F.explode(F.sequence(F.col("place"), F.col("place") + k - 1)).alias("covered")
    each = merged.select("row", "template", "stretch", "start", "end", F.explode("places").alias("place"))
    covered = each.select("row", "template", "stretch", "start", "end", inner).groupBy("row", "template", "stretch", "covered").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = covered.groupBy("row", "template", "stretch").agg(F.count("*").alias("covered"), F.min("start").alias("start"), F.max("end").alias("end"))
    sized = whole.join(F.broadcast(listed.select("template", "size")), "template")
    return sized.select("row", "template", "start", "end", (F.col("covered") / F.greatest(F.col("size"), F.col("end") - F.col("start"))).alias("share"))


def _best_of_each_place(found: DataFrame) -> DataFrame:
    """Of spans that overlap, in a chain too, the one with the largest share; of equal ones the longest, then the first template."""
    before = W.partitionBy("row").orderBy("start", "end", "template").rowsBetween(W.unboundedPreceding, -1)
    apart = F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(False)).cast("int")
    chained = found.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(before.rowsBetween(W.unboundedPreceding, W.currentRow)))
    better = W.partitionBy("row", "chain").orderBy(F.desc("share"), F.desc(F.col("end") - F.col("start")), "template")
    return chained.withColumn("nth", F.row_number().over(better)).where("nth = 1").drop("apart", "chain", "nth")


def license_notices(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES,
    k: int = 3, drift: int = 8, least_share: float = 0.75,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``places``, ``spans`` and ``score`` of every row of ``docs``.

    Reads ``doc_id`` and ``text`` only. All word k-grams of the texts are
    joined with those of the templates; votes are counted by diagonal, the
    place in the text less the place in the template. ``places`` (label, start,
    end; in words from 0, by start) are diagonals on which every k-gram of a
    phrase votes. ``spans`` (label, start, end, share; by start) are stretches
    of neighbouring diagonals that cover ``least_share`` of a notice; of those
    that overlap the best stays. ``score`` is 1 with a place, else the largest
    share that any notice reaches, 0 without a vote. A null or empty text has
    no words. Rows that share or lack a ``doc_id`` give a row each; an empty
    table gives an empty result. Only votes are shuffled, by document.
    """
    spark = docs.sparkSession
    listed = templates(spark, phrases, notices)
    small = sum(len(text) for _, text in [*phrases, *notices]) <= BROADCAST_CHARACTERS
    if any(r["size"] < k for r in listed.select("size").collect()):
        raise ValueError(f"a template needs at least {k} words")
    voted = votes(docs, listed, k, small)
    kinds = listed.select("template", "label", "exact", "size")
    cast = voted.where(F.col("template").isNotNull()).join(F.broadcast(kinds), "template")
    diagonal = (F.col("pos") - F.col("place")).alias("start")
    whole = cast.where("exact").groupBy("row", "template", "label", "size", diagonal).agg(F.count("*").alias("n")).where(F.col("n") == F.col("size") - k + 1)
    places = whole.select("row", F.struct("start", (F.col("start") + F.col("size")).alias("end"), "label").alias("at"))
    found = cut_lineage(spans(cast.where("NOT exact").select("row", "template", "place", "pos"), listed, k, drift))
    good = _best_of_each_place(found.where(F.col("share") >= least_share)).join(F.broadcast(kinds), "template")
    each = (
        voted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"))
        .join(places.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("places")), "row", "left")
        .join(good.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "share"))).alias("spans")), "row", "left")
        .join(found.groupBy("row").agg(F.max("share").alias("share")), "row", "left")
    )
    named = lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"))
    shared = lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["share"].alias("share"))
    none = F.array()
    return each.select(
        "doc_id", "n_words",
        F.coalesce(F.transform("places", named), none.cast("array<struct<label:string,start:bigint,end:bigint>>")).alias("places"),
        F.coalesce(F.transform("spans", shared), none.cast("array<struct<label:string,start:bigint,end:bigint,share:double>>")).alias("spans"),
        F.when(F.col("places").isNotNull(), 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
