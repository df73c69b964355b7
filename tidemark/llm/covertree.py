"""Exact cosine links between vectors by dual traversal of cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import cut_lineage

#: Distances this near to a bound are not decided by the bound.
SLACK = 1e-9
SAMPLE = 512
CENTERS = 32
TASK_ROWS = 4096
LOCAL_LEAF = 128
#: Bytes of vectors whose trees a task keeps at hand: a block meets many others in turn.
TREE_BYTES = 32 << 20
#: Stored blocks are met in groups of so many bytes, at least so many groups.
GROUP_BYTES, LEAST_GROUPS = 16 << 20, 4
#: Bytes of centres that every task may hold; for more of them the vectors are shuffled.
CENTRE_BYTES = 16 << 20


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    rows = column.combine_chunks()
    values = np.asarray(rows.flatten(), np.float64)
    return values.reshape(len(rows), -1) if len(rows) else values.reshape(0, 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _net(points: np.ndarray, radius: float, least: int, most: int) -> np.ndarray:
    """Numbers of centres, each the point farthest from those before, until all lie within ``radius``."""
    chosen = [0]
    away = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(most, len(points)):
        far = int(away.argmax())
        if away[far] <= SLACK or (away[far] <= radius and len(chosen) >= least):
            break
        chosen.append(far)
        away = np.minimum(away, np.linalg.norm(points - points[far], axis=1))
    return np.array(chosen)


class Tree:
    """Nested levels of one block of unit vectors: every node has a centre and the radius that covers its points."""

    def __init__(self, raw: np.ndarray):
        # by powers of two, which changes no digit, so that squares neither overflow nor vanish
        raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])
        self.raw, self.points, self.length = raw, _unit(raw), np.linalg.norm(raw, axis=1)
        self.nodes: list[tuple[np.ndarray, np.ndarray, float, list[int]]] = []
        self.root = self._grow(np.arange(len(raw)), 2.0)

    def _grow(self, inside: np.ndarray, radius: float) -> int:
        own = self.points[inside]
        centre = own[0]
        cover = float(np.linalg.norm(own - centre, axis=1).max())
        children: list[int] = []
        if len(inside) > LOCAL_LEAF and cover > SLACK:
            radius = min(radius, cover) / 2
            centres = own[_net(own, radius, 2, 16)]
            nearest = ((own[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
            children = [self._grow(inside[nearest == k], radius) for k in range(len(centres)) if (nearest == k).any()]
        self.nodes.append((inside, centre, cover, children))
        return len(self.nodes) - 1


def _links(left: Tree, right: Tree | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of index lists that link: (i, j) element by element, or all of i with all of j."""
    same = right is None
    right = left if same else right
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    stack = [(left.root, right.root)]
    while stack:
        a, b = stack.pop()
        ia, ca, ra, childa = left.nodes[a]
        ib, cb, rb, childb = right.nodes[b]
        own = same and a == b
        apart = float(np.linalg.norm(ca - cb))
        if apart > ra + rb + reach + SLACK:
            continue
        if apart + ra + rb < reach - SLACK and (own or not same or a != b):
            yield ia, ib, True
            continue
        if not childa and not childb:
            cosine = (left.raw[ia] @ right.raw[ib].T) / (left.length[ia][:, None] * right.length[ib][None])
            i, j = np.nonzero(np.triu(cosine >= threshold, 1) if own else cosine >= threshold)
            if len(i):
                yield ia[i], ib[j], False
        elif own:
            stack += [(childa[x], childa[y]) for x in range(len(childa)) for y in range(x, len(childa))]
        elif childa and (not childb or ra >= rb):
            stack += [(c, b) for c in childa]
        else:
            stack += [(a, c) for c in childb]


def _walk_blocks(threshold: float, cell_type: str):
    """Task: for every pair of blocks, how many rows each vector links with (kind 0) and a spanning forest of the links (kind 1)."""

    def task(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[bytes, Tree] = {}
        held = 0

        def grown(ids: bytes, cell: bytes) -> Tree:
            nonlocal held
            if ids not in trees:
                vectors = np.frombuffer(cell, cell_type).astype(np.float64).reshape(len(ids) // 8, -1)
                held += vectors.nbytes
                while trees and held > TREE_BYTES:
                    held -= trees.pop(next(iter(trees))).raw.nbytes
                trees[ids] = Tree(vectors)
            return trees[ids]

        for batch in arrived:
            kinds, first, second = [], [], []
            for cells in zip(*(batch.column(c) for c in ("ids_a", "copies_a", "vectors_a", "ids_b", "copies_b", "vectors_b", "same"))):
                ids_a, copies_a, va, ids_b, copies_b, vb, same = (c.as_py() for c in cells)
                left, right = grown(ids_a, va), None if same else grown(ids_b, vb)
                ids_a, copies_a = np.frombuffer(ids_a, "<i8"), np.frombuffer(copies_a, "<i8")
                ids_b, copies_b = np.frombuffer(ids_b, "<i8"), np.frombuffer(copies_b, "<i8")
                na, nb = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
                parent = list(range(len(ids_a) + (0 if same else len(ids_b))))
                shift = 0 if same else len(ids_a)

                def root(x: int) -> int:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for i, j, every in _links(left, right, threshold):
                    if every and same and i is j:
                        na[i] += copies_a[i].sum() - copies_a[i]
                    elif every:
                        na[i] += copies_b[j].sum()
                        (na if same else nb)[j] += copies_a[i].sum()
                    else:
                        np.add.at(na, i, copies_b[j])
                        np.add.at(na if same else nb, j, copies_a[i])
                    if every:  # a star over both lists joins what all their pairs join
                        i, j = np.concatenate([np.full(len(j), i[0]), i]), np.concatenate([j, np.full(len(i), j[0])])
                    for x, y in zip(i.tolist(), (j + shift).tolist()):
                        rx, ry = root(x), root(y)
                        if rx != ry:
                            parent[max(rx, ry)] = min(rx, ry)
                            kinds.append(1)
                            first.append(int(ids_a[x]) if x < len(ids_a) else int(ids_b[x - shift]))
                            second.append(int(ids_a[y]) if y < len(ids_a) else int(ids_b[y - shift]))
                for ids, n in ((ids_a, na), (ids_b, nb)):
                    some = np.flatnonzero(n)
                    kinds += [0] * len(some)
                    first += ids[some].tolist()
                    second += n[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["kind", "a", "b"])

    return task


def _choose(radius: float):
    """Grouped task: centres for the children of one node, from a sample of its vectors."""

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("vertex")
        points = _unit(_matrix(table.column("vector")))
        centres = points[_net(points, radius, 8, CENTERS)]
        if len(centres) == 1:  # nothing but one direction: dealt by number, all around the same centre
            centres = np.repeat(centres, CENTERS, axis=0)
        node = table.column("node")[0].as_py()
        return pa.table({
            "node": pa.array([node] * len(centres), pa.string()), "child": pa.array([f"{node}/{k}" for k in range(len(centres))]),
            "centre": pa.array(centres.tolist(), pa.list_(pa.float64())),
        })

    return task


def _assign(key, rows: pa.Table, centres: pa.Table) -> pa.Table:
    """Grouped task: the nearest child of every vector of one part of a node, and how far its centre is."""
    centres = centres.sort_by("child")
    return _nearest(rows, centres.column("child").to_pylist(), _matrix(centres.column("centre")))


def _nearest(rows: pa.Table, children: list[str], middle: np.ndarray) -> pa.Table:
    points = _unit(_matrix(rows.column("vector")))
    away = np.sqrt(np.maximum(((points[:, None, :] - middle[None]) ** 2).sum(2), 0))
    nearest = away.argmin(1)
    if len(middle) > 1 and (middle == middle[0]).all():
        nearest = rows.column("vertex").to_numpy() % len(middle)
    return pa.table({
        "vertex": rows.column("vertex"), "copies": rows.column("copies"), "vector": rows.column("vector"),
        "parent": rows.column("node"), "node": pa.array([children[k] for k in nearest.tolist()], pa.string()),
        "away": pa.array(away[np.arange(len(points)), nearest]),
    })


def _assign_here(held):
    """Task: as ``_assign``, for the vectors as they lie; ``held`` has the children and centres of all nodes."""

    def task(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            table = pa.Table.from_batches([batch]).sort_by("node")
            nodes = table.column("node").to_pylist()
            edges = [0, *(k for k in range(1, len(nodes)) if nodes[k] != nodes[k - 1]), len(nodes)]
            for a, b in zip(edges, edges[1:]):
                for at in range(a, b, TASK_ROWS):
                    yield from _nearest(table.slice(at, min(TASK_ROWS, b - at)), *held.value[nodes[a]]).combine_chunks().to_batches()

    return task


def _cell_type(single: bool) -> str:
    return "<f4" if single else "<f8"


def _block(key, table: pa.Table, reached: pa.Table) -> pa.Table:
    """Grouped task: the vectors of one leaf as one row, with the leaves it is walked with."""
    vectors = _matrix(table.column("vector")).astype(_cell_type(table.schema.field("vector").type.value_type == pa.float32()))
    cells = [np.asarray(table.column(c)).astype("<i8").tobytes() for c in ("vertex", "copies")] + [vectors.tobytes()]
    met = pa.array([reached.column("b").to_pylist()], pa.list_(pa.string()))
    return pa.table({"node": table.column("node").slice(0, 1), "reached": met, **{n: pa.array([c], pa.binary()) for n, c in zip(("ids", "copies", "vectors"), cells)}})


def _apart(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def vector_links(vertices: DataFrame, threshold: float, leaf_rows: int = 1024) -> DataFrame:
    """``kind``, ``a``, ``b``: rows each vertex links with (kind 0: vertex, number) and a forest of the links (kind 1).

    ``vertices`` has ``vertex``, ``tree`` (only vectors of one tree are
    compared), ``copies`` and ``vector``. Every tree starts as one node. Nodes
    of more than ``leaf_rows`` vectors are split level by level around centres
    whose radius halves each time, and pairs of nodes follow their children
    as long as the centres are nearer than both covering radii and the reach
    of the threshold together. Pairs of leaves that are left are walked inside
    tasks, again by nested levels. A pair that lies within the reach whole is
    counted, not listed.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    vector = vertices.schema["vector"].dataType.simpleString()
    kinds = f"vertex long, copies long, vector {vector}, parent string, node string, away double"
    # as hexadecimal digits, so that a node's tree is what stands before the first slash
    inside = vertices.select("vertex", "copies", "vector", F.hex("tree").alias("node"))
    nodes = cut_lineage(inside.groupBy("node").agg(F.count("*").alias("n"), F.min("vertex").alias("first")))
    pairs = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    radius, done = 2.0, []
    while True:
        hot = cut_lineage(nodes.where(F.col("n") > leaf_rows).select("node", "n", "first"))
        leaf = inside.join(hot.select("node"), "node", "left_anti")
        done.append(leaf.select("vertex", "copies", "vector", "node"))
        if hot.isEmpty():
            break
        radius /= 2
        # read again from the level before, which is stored, and not stored once more
        split = inside.join(hot, "node")
        drawn = F.pmod(F.xxhash64("vertex"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * SAMPLE / F.col("n")
        # a node's first vector is always drawn, so that none is without a centre
        sample = split.where(drawn | (F.col("vertex") == F.col("first"))).select("node", "vertex", "vector")
        centres = cut_lineage(sample.groupBy("node").applyInArrow(_choose(radius), "node string, child string, centre array<double>"))
        moved = cut_lineage(_moved(split, hot, centres, kinds))
        # radii of the children; what was small already stays, without a radius to prune by
        covers = moved.groupBy("parent", "node").agg(F.count("*").alias("n"), F.min("vertex").alias("first"), F.max("away").alias("cover"))
        covers = covers.join(centres.select(F.col("child").alias("node"), "centre"), "node")
        covers = cut_lineage(covers)
        small = nodes.join(hot.select("node"), "node", "left_anti")
        kept = small.select("node", "n", "first", *[F.col(c) if c in small.columns else F.lit(None).cast(k).alias(c) for c, k in (("cover", "double"), ("centre", "array<double>"))])
        nodes = covers.select("node", "n", "first", "cover", "centre").union(kept)
        opened = covers.select("parent", "node", "cover", "centre").union(kept.select(F.col("node").alias("parent"), "node", "cover", "centre"))
        opened = cut_lineage(opened)
        left = opened.select(F.col("parent").alias("a"), F.col("node").alias("na"), F.col("cover").alias("ra"), F.col("centre").alias("ca"))
        right = opened.select(F.col("parent").alias("b"), F.col("node").alias("nb"), F.col("cover").alias("rb"), F.col("centre").alias("cb"))
        near = F.coalesce(_apart("ca", "cb") <= F.col("ra") + F.col("rb") + reach + SLACK, F.lit(True))
        grown = pairs.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("na") <= F.col("nb"))).where(near)
        pairs = cut_lineage(grown.select(F.col("na").alias("a"), F.col("nb").alias("b")))
        nodes, inside = cut_lineage(nodes), moved
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.union(more)
    grouped = leaves.groupBy("node").cogroup(pairs.select(F.col("a").alias("node"), "b").groupBy("node"))
    blocks = cut_lineage(grouped.applyInArrow(_block, "node string, reached array<string>, ids binary, copies binary, vectors binary"))
    # both sides are read where they were written, nothing is shuffled: a block is in many pairs
    size = blocks.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0
    cells, tree = ("ids", "copies", "vectors"), F.substring_index("node", "/", 1)
    asked = blocks.select(F.col("node").alias("a"), "reached", tree.alias("tree_a"), *[F.col(c).alias(f"{c}_a") for c in cells])
    stored = blocks.select(F.col("node").alias("b"), tree.alias("tree_b"), *[F.col(c).alias(f"{c}_b") for c in cells])
    stored = stored.coalesce(max(LEAST_GROUPS, -(-size // GROUP_BYTES))).hint("shuffle_replicate_nl")
    walked = asked.join(stored, (F.col("tree_a") == F.col("tree_b")) & F.array_contains("reached", F.col("b")))
    walked = walked.withColumn("same", F.col("a") == F.col("b")).drop("a", "b", "tree_a", "tree_b", "reached")
    return walked.mapInArrow(_walk_blocks(threshold, _cell_type(vector == "array<float>")), "kind int, a long, b long")


def _moved(split: DataFrame, hot: DataFrame, centres: DataFrame, kinds: str) -> DataFrame:
    """The vectors of the hot nodes with their nearest child."""
    if (centres.agg(F.sum(F.size("centre") * 8)).first()[0] or 0) <= CENTRE_BYTES:
        known: dict[str, tuple[list[str], list]] = {}
        for r in sorted(centres.collect(), key=lambda r: r["child"]):
            children, middle = known.setdefault(r["node"], ([], []))
            children.append(r["child"])
            middle.append(r["centre"])
        held = split.sparkSession.sparkContext.broadcast({node: (children, np.array(middle, np.float64)) for node, (children, middle) in known.items()})
        return split.select("vertex", "copies", "vector", "node").mapInArrow(_assign_here(held), kinds)
    parts = F.ceil(F.col("n") / TASK_ROWS)
    dealt = split.select("vertex", "copies", "vector", "node", F.pmod(F.xxhash64("vertex"), parts).alias("part"))
    copies = centres.join(hot, "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.groupBy("node", "part").cogroup(copies.groupBy("node", "part")).applyInArrow(_assign, kinds)


def _marks() -> dict[str, Column]:
    """128 bits that tell vectors from each other, nearly always."""
    return {"mark_a": F.xxhash64("vector"), "mark_b": F.xxhash64(F.lit(1), "vector")}


def near_vectors(vectors: DataFrame, threshold: float = 0.93, leaf_rows: int = 1024) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``vectors``.

    Reads ``vec_id``, ``embedding`` and ``label`` only. Two rows link if their
    labels are equal and not null and the cosine of their vectors, in double
    precision, is at least ``threshold``. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do those of
    different width, or rows without a ``vec_id``. ``n_links`` counts rows, so
    equal vectors and rows that repeat a ``vec_id`` count each. ``component_id``
    is the smallest ``vec_id`` reachable, a row's own without links (null if
    it has none). An empty table gives an empty result.
    """
    # doubles stay doubles
    exact = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(exact).alias("vector"), F.col("label").cast("string").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    tree = F.concat_ws(":", F.size("vector").cast("string"), F.col("label"))
    usable = rows.where("sound").select("vec_id", "vector", tree.alias("tree"))
    distinct = usable.groupBy("tree", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    distinct = cut_lineage(distinct.withColumn("vertex", F.monotonically_increasing_id()))
    found = cut_lineage(vector_links(distinct, threshold, leaf_rows))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("vertex")).agg(F.sum("b").alias("others"))
    roots = components(found.where("kind = 1"), "a", "b")
    marks = _marks()
    keys = ["tree", *marks]
    named = distinct.select("vertex", "first", "copies", "tree", *[c.alias(k) for k, c in marks.items()])
    # vectors stay where they are while their 128 bits differ
    if not named.groupBy(*keys).count().where("count > 1").isEmpty():
        keys, named = ["tree", "vector"], distinct.select("vertex", "first", "copies", "tree", "vector")
    named = named.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = named.join(least, "root").join(counts, "vertex", "left")
    facts = cut_lineage(facts.select(*keys, "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    said = usable.select("vec_id", "tree", *[F.col(k) if k == "vector" else marks[k].alias(k) for k in keys[1:]])
    linked = said.join(facts, keys).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
