"""Registered queries of the operators in this package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import covertree, exact, folds, html, language, licenses, mixing, packing, periodic, pii, simhash, suffixes, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed_documents(_table(spark, sf_dir, "documents"), tokenizer, length=2048, end_id=0)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"), block_words=64, weights=(1, 2, 3), most_copies=3).drop("source")


OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * sum(size) AS cap, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM source WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (
  SELECT sid, source, source_size, CAST(CASE WHEN cap <= level * weight THEN cap
         ELSE weight * max(CASE WHEN cap > level * weight THEN level END) OVER () END AS DOUBLE) AS target FROM levels),
ranges AS (
  SELECT *, CAST(round(target) AS BIGINT) AS quota,
         CASE WHEN sid = max(sid) OVER () THEN 1.0 ELSE coalesce(sum(target) OVER (ORDER BY sid) / nullif(sum(target) OVER (), 0), 0) END AS hi,
         coalesce(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / nullif(sum(target) OVER (), 0), 0) AS lo
  FROM shares),
point AS (
  SELECT i AS slot, list_sum(list_transform(range(40), lambda k: ((i >> k) & 1) / CAST(2 ** (k + 1) AS DOUBLE))) AS x
  FROM range((SELECT CAST(ceil(coalesce(sum(source_size), 0) / 64) AS BIGINT) FROM source)) t(i)),
planned AS (
  SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block FROM point JOIN ranges ON lo <= x AND x < hi
  UNION ALL
  SELECT (SELECT count(*) FROM point) + sid, sid, 0 FROM ranges r WHERE NOT EXISTS (SELECT 1 FROM point WHERE r.lo <= x AND x < r.hi)),
filled AS (
  SELECT sid, CASE WHEN any_value(quota) < 64 THEN any_value(quota) ELSE least(count(*) * 64, 3 * any_value(source_size)) END AS words
  FROM planned JOIN ranges USING (sid) GROUP BY sid),
placed AS (
  SELECT d.doc_id, d.size, s.sid, s.source_size, s.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN ranges s ON d.source IS NOT DISTINCT FROM s.source),
met AS (SELECT *, CASE WHEN size > 0 AND start < words THEN start // 64 END AS block FROM placed LEFT JOIN filled USING (sid))
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, words - start))
     + greatest(0, least(size, words - start - source_size)) + greatest(0, least(size, words - start - 2 * source_size)) AS BIGINT) AS taken,
     CAST(slot AS BIGINT) AS first_slot
FROM met LEFT JOIN planned USING (sid, block)
"""


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learn = toxicity.bounded_labels(labels.where(~folds.held_out(F.col("doc_id"))), "toxic", most_rows=12_000)
    # a bounded sample: 12,000 ids at most
    model = toxicity.train(docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id"))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_sha256")).alias("text_sha256"))


OP7 = """
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
named AS (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size, sha256(text) AS text_sha256
  FROM lowered)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM named
"""

def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(~folds.held_out(F.col("doc_id"))), docs_per_language=2000)
    found = language.languages(docs, model)
    return found.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_strings(_table(spark, sf_dir, "documents"), width=50)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["strict"])

    def digest(spans) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_notices(_table(spark, sf_dir, "documents"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    starts, base = F.col("places.start"), F.col("places.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("spans.label"))).alias("labels"), "score",
    )


def _values(listed: list[tuple[str, str]], first: int) -> str:
    return ", ".join(f"({i}, '{label}', '{text.translate(str.maketrans(licenses.UPPER, licenses.LOWER))}')" for i, (label, text) in enumerate(listed, first))


OP11 = rf"""
WITH phrase(template, label, text) AS (VALUES {_values(licenses.PHRASES, 0)}),
notice(template, label, text) AS (VALUES {_values(licenses.NOTICES, len(licenses.PHRASES))}),
listed AS (
  SELECT template, label, exact, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT *, true AS exact FROM phrase UNION ALL SELECT *, false FROM notice)),
spoken AS (
  SELECT row_number() OVER () AS "row", doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
known AS (
  SELECT template, label, exact, len(words) AS size, unnest(range(len(words) - 2)) AS place, words FROM listed),
said AS (SELECT "row", unnest(range(len(words) - 2)) AS pos, words FROM spoken),
vote AS (
  SELECT s."row", k.template, k.label, k.exact, k.size, k.place, s.pos FROM said s JOIN known k
  ON s.words[s.pos + 1] = k.words[k.place + 1] AND s.words[s.pos + 2] = k.words[k.place + 2] AND s.words[s.pos + 3] = k.words[k.place + 3]),
places AS (
  SELECT "row", label, pos - place AS start FROM vote WHERE exact GROUP BY "row", template, label, size, pos - place HAVING count(*) = size - 2),
stepped AS (
  SELECT *, coalesce(pos - place - lag(pos - place) OVER near > 8, false) AS apart FROM vote WHERE NOT exact
  WINDOW near AS (PARTITION BY "row", template ORDER BY pos - place)),
stretched AS (
  SELECT *, sum(apart::INT) OVER (PARTITION BY "row", template ORDER BY pos - place) AS stretch FROM stepped),
span AS (
  SELECT "row", template, label, min(pos) AS start, max(pos) + 3 AS "end",
         CAST(len(list_distinct(flatten(list([place, place + 1, place + 2])))) AS DOUBLE) / greatest(any_value(size), max(pos) + 3 - min(pos)) AS share
  FROM stretched GROUP BY "row", template, label, stretch),
chained AS (
  SELECT *, coalesce(max("end") OVER (before ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= start, false) AS apart FROM span WHERE share >= 0.75
  WINDOW before AS (PARTITION BY "row" ORDER BY start, "end", template)),
numbered AS (SELECT *, sum(apart::INT) OVER (PARTITION BY "row" ORDER BY start, "end", template) AS chain FROM chained),
best AS (SELECT "row", label FROM numbered QUALIFY row_number() OVER (PARTITION BY "row", chain ORDER BY share DESC, "end" - start DESC, template) = 1),
base AS (
  SELECT "row", count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY "row"),
every AS (
  SELECT "row", string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT "row", label FROM places UNION ALL SELECT "row", label FROM best) GROUP BY "row"),
scored AS (SELECT "row", max(share) AS share FROM span GROUP BY "row")
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM spoken LEFT JOIN base USING ("row") LEFT JOIN every USING ("row") LEFT JOIN scored USING ("row")
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The contract's texts: with h = crc32(doc_id) divisible by ten, the words from a place on repeat some of them.

    Others, and rows without an id, keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    n, a, g = F.size("words"), F.col("a"), F.col("g")
    placed = split.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    source = F.transform(F.sequence(a, n - 1), lambda i: F.get("words", a + (i - a) % F.col("p")))
    whole = F.array_join(F.concat(F.slice("words", F.lit(1), a), source), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(repeated_tails(_table(spark, sf_dir, "documents")), least_words=6, least_periods=4)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # by start, then period, so the first of equal ones stays
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | more(best, r), r).otherwise(best))
    line = lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_simhash": op1_simhash, "op2_packing": op2_packing, "op3_embeddings": op3_embeddings, "op4_mixing": op4_mixing, "op5_html": op5_html,
    "op6_toxicity": op6_toxicity, "op7_exact": op7_exact, "op8_language": op8_language, "op9_suffixes": op9_suffixes, "op10_pii": op10_pii,
    "op11_licenses": op11_licenses, "op12_whitening": op12_whitening, "op13_periodic": op13_periodic,
}
ORACLE = {"op4_mixing": OP4, "op7_exact": OP7, "op11_licenses": OP11}
