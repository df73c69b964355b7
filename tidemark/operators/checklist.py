"""Coverage of checklists by the marks of many runs.

Marks grow with the runs; every per-run figure is one row per run and item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import search

TOP_ITEMS = 5
# template rows per array
BLOCK = 10_000
# Fixed value: opening of the search text for missing items.
ADVICE_QUERY = "Forneça recomendações para implementar os seguintes itens de QA de Big Data:\n"


def latest_marks(marks: DataFrame, order_by: list[str]) -> DataFrame:
    """One status per (run, item), the one set last; combined on the map side."""
    last = F.max(F.struct(*order_by, "status")).getField("status")
    return marks.groupBy("run_id", "item_id").agg(last.alias("status"))


def coverage(latest: DataFrame, items: DataFrame) -> DataFrame:
    """Done marks per run over the number of items; marks of unknown items count."""
    total = items.agg(F.count(F.lit(1)).alias("total_items"), F.lit(1).alias("__one"))
    done = latest.groupBy("run_id").agg(F.count_if(F.col("status") == "DONE").alias("done_items"))
    share = F.coalesce(F.try_divide(F.col("done_items") * F.lit(100.0), F.col("total_items")), F.lit(0.0))
    return (
        done.withColumn("__one", F.lit(1))
        .join(F.broadcast(total), "__one")
        .select("run_id", "total_items", "done_items", F.round(share, 1).alias("coverage"))
    )


def _with_template(latest: DataFrame, template: DataFrame) -> DataFrame:
    """Every run with every row of the template.

    The template is packed into arrays of about BLOCK rows; each run meets the
    arrays by block number and unpacks them.
    """
    blocks = -(-template.count() // BLOCK) or 1
    columns = template.columns
    packed = template.groupBy(F.pmod(F.xxhash64(columns[0]), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct(*columns)).alias("rows")
    )
    runs = latest.select("run_id").distinct()
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    numbered = runs.select("run_id", numbers.alias("block"))
    near = F.broadcast(packed) if blocks == 1 else packed
    return numbered.join(near, "block").select("run_id", F.inline("rows"))


def run_items(latest: DataFrame, items: DataFrame) -> DataFrame:
    """Every run with every item and its status, NULL where unmarked."""
    grid = _with_template(latest, items.select("item_id", "dimension", "priority_weight"))
    return grid.join(latest, ["run_id", "item_id"], "left")


def coverage_by_dimension(latest: DataFrame, items: DataFrame) -> DataFrame:
    """Known items per dimension and how many of them each run has done."""
    sizes = items.groupBy("dimension").agg(F.count(F.lit(1)).alias("total"))
    done = (
        latest.filter(F.col("status") == "DONE")
        .join(items.select("item_id", "dimension"), "item_id")
        .groupBy("run_id", "dimension")
        .agg(F.count(F.lit(1)).alias("done"))
    )
    grid = _with_template(latest, sizes)
    share = F.col("done") * F.lit(100.0) / F.col("total")
    return (
        grid.join(done, ["run_id", "dimension"], "left")
        .withColumn("done", F.coalesce("done", F.lit(0).cast("long")))
        .select("run_id", "dimension", "done", "total", F.round(share, 1).alias("coverage"))
    )


def missing_items(latest: DataFrame, items: DataFrame) -> DataFrame:
    """Items not done per run with their place, heaviest first, then template order."""
    order = Window.partitionBy("run_id").orderBy(F.desc("priority_weight"), "item_id")
    open_items = run_items(latest, items).filter(~F.col("status").eqNullSafe(F.lit("DONE")))
    return open_items.select(
        "run_id", "item_id", "dimension", "priority_weight", F.row_number().over(order).alias("place")
    )


def heaviest_missing(latest: DataFrame, items: DataFrame, n: int = TOP_ITEMS) -> DataFrame:
    """The first ``n`` of ``missing_items`` of every run, without meeting the rest of the template.

    They lie among the first n items of the template and as many more as the
    run has done, so a run meets no more items than it has marks, and n.
    """
    # the template is sorted once; a run has a row per mark
    ranked = items.select(
        "item_id", "dimension", "priority_weight",
        F.row_number().over(Window.orderBy(F.desc("priority_weight"), "item_id")).alias("at"),
    )
    done = latest.filter(F.col("status") == "DONE").join(ranked.select("item_id"), "item_id", "left_semi").select("run_id", "item_id")
    counts = done.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("done"))
    runs = latest.select("run_id").distinct().join(counts, "run_id", "left")
    reach = F.sequence(F.lit(1), F.lit(n) + F.coalesce("done", F.lit(0)))
    near = runs.select("run_id", F.explode(reach).alias("at")).join(ranked, "at")
    place = Window.partitionBy("run_id").orderBy("at")
    still_open = near.join(done, ["run_id", "item_id"], "left_anti").withColumn("place", F.row_number().over(place))
    return still_open.filter(F.col("place") <= n).select("run_id", "item_id", "dimension", "priority_weight", "place")


def recommendations(latest: DataFrame, items: DataFrame, documents: DataFrame, k: int = 5, shown: int = 3) -> DataFrame:
    """Per run: its heaviest missing items and the files found for them.

    Runs that miss the same items share one search.
    """
    top = heaviest_missing(latest, items)
    named = top.join(items.select("item_id", "code", "title"), "item_id")
    listed = F.array_sort(F.collect_list(F.struct("place", "code", "title")))
    text = F.concat(
        F.lit(ADVICE_QUERY),
        F.array_join(F.transform("top", lambda t: F.concat(t["code"], F.lit(": "), t["title"])), "\n"),
    )
    per_run = named.groupBy("run_id").agg(listed.alias("top")).select(
        "run_id", F.transform("top", lambda t: t["code"]).alias("missing_codes"), text.alias("query")
    )
    with_id = per_run.withColumn("query_id", F.xxhash64("query"))
    queries = with_id.select("query_id", "query").dropDuplicates(["query_id"])
    hits = search(documents, queries, k, texts=False).filter(F.col("rank") <= shown)
    files = (
        hits.join(documents.select("doc_id", "filename"), "doc_id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "filename"))).alias("f"))
        .select("query_id", F.transform("f", lambda x: x["filename"]).alias("sources"))
    )
    return with_id.join(files, "query_id", "left").select("run_id", "missing_codes", "sources")
