"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _nearest(links: DataFrame) -> DataFrame:
    """The smallest smaller neighbour of each vertex that has one.

    Written out, so that the joins with it start from two plain exchanges,
    which adaptive execution can split where one vertex has very many links.
    """
    return cut_lineage(links.groupBy("hi").agg(F.min("lo").alias("to")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``vertex`` and ``root`` for every vertex that has a link to another one.

    ``a`` and ``b`` are long columns; rows with a null or with equal ends are
    no links. ``root`` is the smallest vertex of the component. Every round
    writes the links to the shared folder; the number of rounds grows with the
    logarithm of the longest path.
    """
    links = cut_lineage(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    while True:
        to = _nearest(links)
        # large star: larger neighbours of a vertex move on to its smallest neighbour
        large = (
            links.join(to.select(F.col("hi").alias("lo"), "to"), "lo", "left")
            .select("hi", F.coalesce("to", "lo").alias("lo"))
            .distinct()
        )
        large = cut_lineage(large)
        to = _nearest(large)
        # small star: a vertex and its smaller neighbours meet at the smallest of them
        small = large.join(to, "hi").select(F.when(F.col("lo") == F.col("to"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("to").alias("lo"))
        links = cut_lineage(small.distinct())
        ends = links.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
        inner = links.select(F.col("lo").alias("hi")).join(links.select("hi"), "hi", "left_semi")
        if ends.union(inner).isEmpty():
            break
    roots = links.select(F.col("hi").alias("vertex"), F.col("lo").alias("root"))
    return roots.union(links.select(F.col("lo").alias("vertex"), F.col("lo").alias("root")).distinct())
