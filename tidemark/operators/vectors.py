"""Nearest vectors by cosine similarity.

Stored vectors lie in cells around pivots, a sample of them. A cell knows the
smallest and the largest angle between its pivot and its members, so the angle
between a query and the pivot bounds the similarity of every member. A query
meets a part of the cells with the highest bounds first; the k-th similarity
there decides which cells it meets at all. Then queries are packed into blocks
of neighbours, and tasks read blocks of queries and groups of stored blocks
where they were written: a query is shuffled a fixed number of times, however
many cells it meets, and a task gives only its k best of a whole group.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# tasks get these functions by value, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A task multiplies a block of query vectors with a block of stored vectors: scores of 32 MB at most.
QUERY_ROWS = 1024
STORED_ROWS = 4096
#: A pivot for so many vectors; beyond the largest number of pivots, which every task knows, cells get larger.
CELL_ROWS = 4096
MOST_PIVOTS = 8192
#: A task holds a group of stored blocks of so many bytes and passes blocks of queries by it.
GROUP_BYTES = 64 << 20
LEAST_GROUPS = 4
SIMILARITY_DIGITS = 6
# two rounding steps, and the rounding of angles
SLACK = 4.0 / 10**SIMILARITY_DIGITS


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(batch: pa.RecordBatch, ids: str, vectors: str, width: int | None, like: str) -> np.ndarray:
    """The vectors of a batch as rows; one of another width is an error."""
    column = batch.column(vectors)
    widths = np.diff(column.offsets.to_numpy())
    expected = width if width is not None else widths[0]
    if (widths != expected).any():
        wrong = int(np.flatnonzero(widths != expected)[0])
        raise ValueError(f"vector {batch.column(ids)[wrong]} has {widths[wrong]} components, {like} has {expected}")
    return column.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(batch.num_rows, -1)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _packed(batches: Iterator[pa.RecordBatch], keys: list[str], ids: str, vectors: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the keys as blocks of at most ``rows`` vectors: the keys, ``<ids>s`` and ``cells``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in keys], 1)
        edges = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        out = []
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            for at in range(a, b, rows):
                part = batch.slice(at, min(rows, b - at))
                cells = part.column(vectors).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                out.append((*values[a].tolist(), part.column(ids).to_numpy().astype("<i8").tobytes(), cells.tobytes()))
        types = [pa.int32()] * len(keys) + [pa.binary()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*keys, f"{ids}s", "cells"])


class _Bounds(NamedTuple):
    """Cells by number, -1 the one of zero vectors, with their pivots and the angles of their members."""

    pivots: np.ndarray
    cells: np.ndarray
    nearest: np.ndarray
    furthest: np.ndarray

    def only(self, cell: int) -> _Bounds:
        at = np.searchsorted(self.cells, [cell])
        return _Bounds(*(x[at] for x in self))

    def of(self, unit: np.ndarray) -> np.ndarray:
        """The largest similarity that a member of each cell can have with each vector."""
        angle = _angles(unit, self.pivots)
        apart = np.maximum(np.maximum(angle - self.furthest, self.nearest - angle), 0.0)
        # a zero vector on either side has similarity 0 and no angle
        return np.where((self.cells < 0)[None, :] | ~unit.any(1)[:, None], 0.0, np.cos(apart))


class VectorIndex:
    """Vectors in cells, kept below the shared folder for any number of searches.

    NULL vectors are left out; vectors of different widths fail the job that
    reads them. Zero vectors have similarity 0 with everything.
    """

    def __init__(self, vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding"):
        spark = vectors.sparkSession
        # blocks are written to a fixed number of files, so that a small table is not left to one task
        self.files = spark.sparkContext.defaultParallelism
        named = vectors.where(F.col(column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
        count = named.count()
        wanted = min(MOST_PIVOTS, -(-count // CELL_ROWS))
        # a bounded sample that any layout gives; the cells are exact whatever it holds
        sampled = named.orderBy(F.xxhash64("id"), "id").limit(max(wanted, 1)).collect()
        self.width = len(sampled[0]["vector"]) if sampled else 0
        self.first = sampled[0]["id"] if sampled else None
        pivots = _unit(np.array([r["vector"] for r in sampled if len(r["vector"]) == self.width], "<f8").reshape(-1, self.width))
        pivots = pivots[np.linalg.norm(pivots, axis=1) > 0] if len(pivots) > 1 else pivots
        width, like = self.width, f"vector {self.first}"

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, STORED_ROWS):
                    part = batch.slice(at, STORED_ROWS)
                    unit = _unit(_matrix(part, "id", "vector", width, like))
                    angle = _angles(unit, pivots)
                    cell = angle.argmin(1)
                    near = angle[np.arange(len(cell)), cell]
                    # zero vectors have no angle: a cell of their own
                    cell[~unit.any(1)] = -1
                    flat = pa.ListArray.from_arrays(np.arange(0, unit.size + 1, width, dtype=np.int32), unit.ravel())
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cell, pa.int32()), pa.array(near), flat], ["id", "cell", "angle", "vector"])

        placed = cut_lineage(named.mapInArrow(place, "id long, cell int, angle double, vector array<double>"))
        # a row per pivot
        found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("nearest"), F.max("angle").alias("furthest")).orderBy("cell").collect()
        self.cells = np.array([r["cell"] for r in found], np.int64)
        self.sizes = np.array([r["n"] for r in found], np.int64)
        nearest, furthest = (np.array([r[c] for r in found]) for c in ("nearest", "furthest"))
        self.bounds = _Bounds(pivots[np.maximum(self.cells, 0)] if len(found) else np.empty((0, self.width)), self.cells, nearest, furthest)
        # a large cell is several parts
        self.parts = -(-self.sizes // STORED_ROWS)
        known = spark.createDataFrame([(int(c), int(p)) for c, p in zip(self.cells, self.parts)], "cell int, parts int")
        dealt = placed.join(F.broadcast(known), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        # ids ascend in a block
        dealt = dealt.repartition(self.files, "cell", "part").sortWithinPartitions("cell", "part", "id").select("cell", "part", "id", "vector")
        pack = lambda batches: _packed(batches, ["cell", "part"], "id", "vector", STORED_ROWS)
        self.blocks = cut_lineage(dealt.mapInArrow(pack, "cell int, part int, ids binary, cells binary"))

    def _reached(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, vector, cell, part, deal, home): of each query's first cells, which hold k vectors, a part each.

        ``home`` is true for the first one. ``deal`` spreads the queries of a
        cell over blocks.
        """
        cells, parts, width, first = self.cells, self.parts, self.width, self.first
        bounds, held = self.bounds, self.sizes // np.maximum(self.parts, 1)
        deals = parts * max(1, STORED_ROWS // QUERY_ROWS)

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERY_ROWS):
                    some = batch.slice(at, QUERY_ROWS)
                    unit = _unit(_matrix(some, "query_id", "vector", width, f"vector {first}"))
                    # without clusters a vector lies between the angles of many cells: the one with the nearest pivot
                    order = np.lexsort((_angles(unit, bounds.pivots), -bounds.of(unit)), axis=1)
                    row, place = np.nonzero(np.cumsum(held[order], axis=1) - held[order] < k)
                    cell = order[row, place]
                    deal = some.column("hash").to_numpy()[row] % deals[cell]
                    taken = [some.column(c).take(pa.array(row)) for c in ("query_id", "vector")]
                    placed = [pa.array(x, pa.int32()) for x in (cells[cell], deal % parts[cell], deal)]
                    yield pa.RecordBatch.from_arrays([*taken, *placed, pa.array(place == 0)], ["query_id", "vector", "cell", "part", "deal", "home"])

        asked = queries.withColumn("hash", F.xxhash64("query_id"))
        return asked.mapInArrow(reach, "query_id long, vector array<double>, cell int, part int, deal int, home boolean")

    def _least(self, reached: DataFrame, k: int) -> DataFrame:
        """(query_id, least): the k-th similarity of each query in the parts it meets first, if they hold k vectors."""
        pack = lambda batches: _packed(batches, ["cell", "part", "deal"], "query_id", "vector", QUERY_ROWS)
        rows = reached.repartition(self.files, "cell", "deal").sortWithinPartitions("cell", "deal").select("cell", "part", "deal", "query_id", "vector")
        asked = rows.mapInArrow(pack, "cell int, part int, deal int, query_ids binary, cells binary")
        asked = asked.select("query_ids", F.col("cells").alias("query_cells"), F.lit(b"").alias("leasts"), F.array("cell").alias("reached"), F.col("part").alias("only"))
        return self._found(asked, k).where(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))

    def _asked(self, reached: DataFrame, least: DataFrame | None) -> DataFrame:
        """(query_ids, query_cells, leasts, reached, only): neighbouring queries and the cells where one of them can find a better vector."""
        rows = reached.where("home").drop("home")
        rows = rows.withColumn("least", F.lit(-2.0)) if least is None else rows.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        rows = rows.repartition(self.files, "cell", "deal").sortWithinPartitions("cell", "deal")
        rows = rows.select("cell", "deal", "query_id", F.concat("vector", F.array("least")).alias("vector"))
        bounds, width = self.bounds, self.width

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for packed in _packed(batches, ["cell", "deal"], "query_id", "vector", QUERY_ROWS):
                out = []
                for ids, cells in zip(packed.column("query_ids").to_pylist(), packed.column("cells")):
                    both = np.frombuffer(cells.as_buffer(), "<f8").reshape(-1, width + 1)
                    vectors, leasts = both[:, :-1].copy(), both[:, -1].copy()
                    meets = ~(bounds.of(_unit(vectors)) < leasts[:, None] - SLACK).all(0)
                    out.append((ids, vectors.tobytes(), leasts.tobytes(), bounds.cells[meets].astype(np.int32)))
                types = [pa.binary()] * 3 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["query_ids", "query_cells", "leasts", "reached"])

        return rows.mapInArrow(pack, "query_ids binary, query_cells binary, leasts binary, reached array<int>").withColumn("only", F.lit(None).cast("int"))

    def _met(self, asked: DataFrame) -> DataFrame:
        """Blocks of queries with the stored blocks of the cells they reach, or of ``only`` that part of them.

        Both sides are read where they were written, nothing is shuffled; in a
        group the stored blocks that a block of queries meets follow each other.
        """
        asked = cut_lineage(asked.select(F.monotonically_increasing_id().alias("block"), "*"))
        groups = max(LEAST_GROUPS, -(-int(self.sizes.sum()) * self.width * 8 // GROUP_BYTES))
        stored = self.blocks.withColumnRenamed("cells", "stored").coalesce(groups).hint("shuffle_replicate_nl")
        met = asked.join(stored, F.array_contains("reached", F.col("cell")) & (F.coalesce("only", "part") == F.col("part")))
        return met.select("block", "query_ids", "query_cells", "leasts", "cell", "ids", "stored")

    def _found(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, id, similarity, rank): the k nearest of each query in the blocks it meets, equal ones by id."""
        bounds = self.bounds
        found = self._met(asked).mapInArrow(lambda batches: _nearest(batches, k, bounds), "query_id long, id long, similarity double")
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int = 8, column: str = "embedding") -> DataFrame:
        """(query_id, rank, id, similarity): the k nearest vectors of every query, equal ones by id."""
        asked = queries.where(F.col(column).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(column).cast("array<double>").alias("vector"))
        reached = self._reached(asked, k)
        least = self._least(reached, k) if len(self.cells) > 1 else None
        return self._found(self._asked(reached, least), k).select("query_id", "rank", "id", "similarity")


class _Nearest:
    """The k nearest of the queries of a block among the stored blocks met so far, equal ones by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.unit, self.least, self.k = ids, _unit(vectors), least, k
        self.row, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def meet(self, bounds: _Bounds, ids: np.ndarray, stored: np.ndarray) -> None:
        rows = np.flatnonzero(~(bounds.of(self.unit)[:, 0] < self.least - SLACK))
        scores = self.unit[rows] @ stored.T
        # a digit is left for rounding
        near = scores >= self.least[rows, None] - 1 / 10**SIMILARITY_DIGITS
        crowded = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * self.k)
        if len(crowded):
            # what is above the k-th score of this block, and the first k of those that reach it
            close = np.round(scores[crowded], SIMILARITY_DIGITS)
            kth = np.partition(close, len(ids) - self.k, axis=1)[:, [len(ids) - self.k]]
            equal = close == kth
            near[crowded] = (close > kth) | (equal & (np.cumsum(equal, axis=1) <= self.k))
        row, place = np.nonzero(near)
        score = np.round(scores[row, place], SIMILARITY_DIGITS)
        row, score, found = np.concatenate([self.row, rows[row]]), np.concatenate([self.score, score]), np.concatenate([self.id, ids[place]])
        order = np.lexsort((found, -score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        best = rank < self.k
        self.row, self.id, self.score = row[best], found[order[best]], score[order[best]]
        last = rank[best] == self.k - 1
        self.least[self.row[last]] = np.maximum(self.least[self.row[last]], self.score[last])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(self.score)], ["query_id", "id", "similarity"])


def _nearest(batches: Iterator[pa.RecordBatch], k: int, bounds: _Bounds) -> Iterator[pa.RecordBatch]:
    block, state = None, None
    for batch in batches:
        for at, cell in enumerate(batch.column("cell").to_pylist()):
            held = lambda name, kind: np.frombuffer(batch.column(name)[at].as_buffer(), kind)  # noqa: B023, E731
            if batch.column("block")[at].as_py() != block:
                if state:
                    yield state.rows()
                block, ids, least = batch.column("block")[at].as_py(), held("query_ids", "<i8").copy(), held("leasts", "<f8")
                state = _Nearest(ids, held("query_cells", "<f8").reshape(len(ids), -1), least.copy() if len(least) else np.full(len(ids), -2.0), k)
            ids = held("ids", "<i8")
            # these were made units when they were placed
            state.meet(bounds.only(cell), ids, held("stored", "<f8").reshape(len(ids), -1))
    if state:
        yield state.rows()


def vector_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 8, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, similarity): the k nearest vectors of every query; ``VectorIndex`` serves several searches."""
    return VectorIndex(vectors, id_column, column).search(queries, k, column).withColumnRenamed("id", id_column)
