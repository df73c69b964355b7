"""Embedding whitening: covariances from exact squares of sums of two dimensions, eigenvectors, whitened vectors."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
#: Entries whose scaled value is beyond this are no longs; their vectors count as non-finite.
LARGEST = 2.0**62
BLOCK = 4096
#: Sums of squares of one block, of two values each, stay below 2**63 up to here; larger values are Python integers.
PLAIN = 1 << 24
LIMB = 60


def _fixed(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of every entry: longs, or Python integers where the values are large."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    # a block of smaller longs adds up to a long
    if np.abs(scaled).max(initial=0.0) < 2.0**50:
        return scaled.astype(np.int64) + SHIFT
    return np.array([[int(v) + SHIFT for v in row] for row in scaled.tolist()], object).reshape(scaled.shape)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of a batch by the block, and their integer vectors."""
    for a in range(0, batch.num_rows, BLOCK):
        part = batch.slice(a, BLOCK)
        flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
        yield part, _fixed(flat.reshape(part.num_rows, -1))


def _centred(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """Whole distances from the centre; plain integers if the squares of a block's add up to a long."""
    if x.dtype != object and max(map(abs, middle)) < 2**50:
        z = x - np.array(middle, np.int64)
        return z if np.abs(z).max(initial=0) < PLAIN else z.astype(object)
    return x.astype(object) - np.array(middle, object)


def _limbs(total: int) -> tuple[Decimal, Decimal]:
    """High and low part of a whole number, for exact sums of any size."""
    return Decimal(total >> LIMB), Decimal(total & ((1 << LIMB) - 1))


LIMBS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def _table(rows: list[tuple[int, int, Decimal, Decimal]]) -> pa.RecordBatch:
    wide = pa.decimal128(38, 0)
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), wide, wide))], ["i", "j", "high", "low"])


def _totals(vectors: DataFrame, task) -> dict[tuple[int, int], int]:
    """Exact totals of what the tasks return per (i, j): as many rows as a matrix has entries."""
    partial = vectors.select("vector").mapInArrow(task, LIMBS)
    total = partial.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in total.collect()}


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows to fit on.

    Rows whose vector is null or empty, or holds null or non-finite entries,
    go; of vectors of several lengths those of the commonest stay, of equally
    common ones the longest.
    """
    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) * SCALE < LARGEST))
    whole = typed.where((F.size("vector") > 0) & finite)
    common = whole.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return whole.where(F.size("vector") == (common["length"] if common else 0))


class Whitening:
    """Means, eigenvalues and unit eigenvectors of integer vectors, fitted exactly.

    ``n``, ``sums`` (per dimension), ``covariance`` (rounded once, from exact
    fractions), ``values`` and ``vectors`` by falling eigenvalue. It has as many
    numbers as the vectors have pairs of dimensions, whatever their number.
    """

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int], middle: list[int]):
        self.n, self.sums, self.middle = n, sums, middle
        size = len(sums)
        # what whole centres leave over, and the squares of exactly centred values
        rest = [s - n * m for s, m in zip(sums, middle)]
        exact = {(i, j): q * n - (rest[i] + (rest[j] if i != j else 0)) ** 2 for (i, j), q in squares.items()}
        self.covariance = np.empty((size, size))
        for i in range(size):
            for j in range(i, size):
                # V(i + j) = V(i) + V(j) + 2 V(i, j)
                twice = exact[i, j] - exact[i, i] - exact[j, j] if i != j else 2 * exact[i, i]
                self.covariance[i, j] = self.covariance[j, i] = float(Fraction(twice, 2 * n * n))
        self.trace = float(Fraction(sum(exact[i, i] for i in range(size)), max(n * n, 1)))
        values, vectors = np.linalg.eigh(self.covariance)
        self.values, self.vectors = values[::-1].copy(), vectors[:, ::-1].copy()

    @property
    def spread(self) -> np.ndarray:
        """Which components have a variance that is more than rounding."""
        return self.values > 1e-12 * max(self.values[0], 0.0)


def fit(vectors: DataFrame) -> Whitening | None:
    """A whitening of all ``vectors``; none for an empty table.

    Two passes: sums, then the squares of every dimension and of every sum of
    two dimensions, of values less the whole part of their mean. Tasks add
    them up exactly, so a pass returns one row per pair and task. The rest of
    the mean is taken off the totals as whole numbers.
    """

    def add(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, []
        for batch in arrived:
            for _, x in _blocks(batch):
                count += len(x)
                total = [t + s for t, s in zip(total or [0] * x.shape[1], x.sum(0).tolist())]
        yield _table([(-1, -1, *_limbs(count))] + [(i, i, *_limbs(t)) for i, t in enumerate(total)] if count else [])

    sums = _totals(vectors, add)
    n = sums.pop((-1, -1), 0)
    if not n:
        return None
    sums = [sums[i, i] for i in range(len(sums))]
    middle = [s // n for s in sums]
    size = len(sums)

    def square(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(i, j): 0 for i in range(size) for j in range(i, size)}
        for batch in arrived:
            for _, x in _blocks(batch):
                z = np.ascontiguousarray(_centred(x, middle).T)
                for i in range(size):
                    both = z[i:] + z[i]
                    both[0] = z[i]
                    squares = (both * both).sum(1).tolist()
                    for j, q in enumerate(squares, i):
                        total[i, j] += q
        yield _table([(i, j, *_limbs(q)) for (i, j), q in total.items() if q])

    found = _totals(vectors, square)
    return Whitening(n, sums, {(i, j): found.get((i, j), 0) for i in range(size) for j in range(i, size)}, middle)


def whitened(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """``vec_id``, ``deviation`` and ``whitened`` (an array of the first components) of every row.

    A deviation beyond a long is null, and so is a component without variance.
    """
    components = min(components, len(model.sums))
    n, middle = model.n, model.middle
    rest = np.array([s - n * m for s, m in zip(model.sums, middle)], object)
    held = model.spread[:components]
    axes = model.vectors[:, :components] / np.sqrt(np.where(held, model.values[:components], 1.0))

    def task(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = (rest / n).astype(np.float64)
        for batch in arrived:
            for part, x in _blocks(batch):
                z = _centred(x, middle)
                largest = int(np.abs(z).max(initial=0)) + 1
                # n z - rest is below n (largest + 1) in size
                small = len(rest) * (n * (largest + 1)) ** 2 < 2**63
                far = z.astype(np.int64) * n - rest.astype(np.int64) if small else z.astype(object) * n - rest
                deviation = [d if d < 2**63 else None for d in (far * far).sum(1).tolist()]
                values = (z.astype(np.float64) - share) @ axes
                rows = [[v if h else None for v, h in zip(row, held)] for row in values.tolist()]
                columns = [part.column("vec_id"), pa.array(deviation, pa.int64()), pa.array(rows, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(task, "vec_id long, deviation long, whitened array<double>")


def whiten(rows: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of every usable row and component.

    Reads ``vec_id`` and ``embedding`` only; see ``usable`` for the rows that
    go. Entries become whole numbers x = floor(1024 c) + 100000, and ``n`` of
    them with sums S are fitted on. ``deviation`` is the sum of (n x - S)
    squared over the dimensions, null beyond a long. ``whitened`` is x less the
    mean, projected on a unit eigenvector of the covariance and divided by the
    root of its eigenvalue; null for a component without variance.
    ``explained`` is the eigenvalue's share of all, null without any variance,
    ``identity_error`` the largest entry of the whitened values' covariance
    less the identity, over the components that have variance. Rows
    that share or lack a ``vec_id`` give rows each; vectors shorter than
    ``components`` give as many as they have dimensions; an empty table gives an
    empty result.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = usable(rows)
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], schema)
    done = cut_lineage(whitened(vectors, model, components))
    kept = [k for k in range(min(components, len(model.sums))) if model.spread[k]]
    # covar_pop centres before it multiplies
    pairs = [F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]).alias(f"{a}_{b}") for a in kept for b in kept if a <= b]
    found = done.agg(*pairs).first().asDict() if pairs else {}
    error = max((abs(v - (k.split("_")[0] == k.split("_")[1])) for k, v in found.items()), default=None)
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values[:components]])
    each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
