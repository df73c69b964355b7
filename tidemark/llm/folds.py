"""Which rows are held out from learning, and bounded samples of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by four; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def thinned(rows: DataFrame, key: str, by: str, most: int, seed: int = 11) -> DataFrame:
    """About ``most`` rows of each value of ``by``, chosen by a hash of ``key``; all rows where there are fewer."""
    share = rows.groupBy(by).agg((F.lit(float(most)) / F.count("*")).alias("__share"))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    # the shares have a row for each label
    return rows.join(F.broadcast(share), by).where(place < F.col("__share")).drop("__share")
