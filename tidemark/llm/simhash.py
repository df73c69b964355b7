"""SimHash near-duplicates: fingerprints linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.components import components
from tidemark.session import cut_lineage

BITS = 64
CHUNK = 1 << 16
LEAF_CELLS = 1 << 10
#: Up to so many dropped rows (16 MB) go to every task; more meet the documents in a shuffle.
BROADCAST_GONE = 500_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text: A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if size > 1 else iter(words)
    total, ones, hashed = 0, np.zeros(BITS, np.int64), map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    while True:
        hashes = np.fromiter(islice(hashed, CHUNK), np.uint64)
        total += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
        if len(hashes) < CHUNK:
            break
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Columns ``doc_id`` and ``fp`` (signed long) for every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, fp long")


def _trie_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays (or of one with itself) at most ``budget`` differing bits apart.

    Walks two tries together: a node is a range of a sorted array whose values
    share ``depth`` leading bits; a pair of nodes whose prefixes differ in more
    than the budget is left. Small pairs of nodes are compared at once.
    """
    same = right is None
    right = left if same else right
    first = int(left[0] >> np.uint64(BITS - depth)) ^ int(right[0] >> np.uint64(BITS - depth)) if depth else 0
    stack = [(0, len(left), 0, len(right), depth, first.bit_count())]
    while stack:
        l0, l1, r0, r1, d, differ = stack.pop()
        own = same and l0 == r0 and l1 == r1
        if differ > budget or l0 == l1 or r0 == r1 or own and l1 - l0 < 2:
            continue
        if (l1 - l0) * (r1 - r0) <= LEAF_CELLS or d == BITS:
            near = np.bitwise_count(left[l0:l1, None] ^ right[None, r0:r1]) <= budget
            i, j = np.nonzero(np.triu(near, 1) if own else near)
            if len(i):
                yield i + l0, j + r0
            continue
        bit = np.uint64(1 << (BITS - 1 - d))
        lm = l0 + int(np.searchsorted(left[l0:l1] & bit, bit))
        rm = r0 + int(np.searchsorted(right[r0:r1] & bit, bit))
        stack += [(l0, lm, r0, rm, d + 1, differ), (lm, l1, rm, r1, d + 1, differ), (l0, lm, rm, r1, d + 1, differ + 1)]
        if not own:
            stack.append((lm, l1, r0, rm, d + 1, differ + 1))


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[int, int]]:
    """Those pairs that join two trees: as many as connect what all of them connect."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in pairs:
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield x, y


def _join_nodes(shifts: list[int], depth: int, budget: int):
    """Task: links inside each pair of trie nodes, as a spanning forest."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for turn, left, right in zip(batch["turn"], batch["left"], batch["right"]):
                a = np.sort(np.asarray(left, np.int64).view(np.uint64))
                b = np.sort(np.asarray(right, np.int64).view(np.uint64))
                both = np.concatenate([a, b])
                pairs = ((i, j + len(a)) for i, j in _trie_pairs(a, b, depth, budget)) if len(b) else _trie_pairs(a, None, depth, budget)
                if links := list(_forest(pairs, len(both))):
                    s = np.uint64(shifts[turn])
                    ends = both[np.array(links)]
                    out.append((ends >> s) | (ends << (np.uint64(BITS) - s)) if s else ends)
            if out:
                ends = np.concatenate(out).view(np.int64)
                yield pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return task


def _prefix(value: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(value), BITS - depth)


def trie_links(fps: DataFrame, max_distance: int = 2, node_rows: int = 256) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct values of ``fp`` at most ``max_distance`` bits apart.

    The bits are cut into ``max_distance`` + 1 runs. Two values within the
    budget agree on one run at least, so in the trie over the bits turned until
    that run leads, they lie below one common node at its depth: the joint
    walk starts from these nodes, each paired with itself. Nodes of up to
    ``node_rows`` values are walked inside one task. Larger ones are opened
    level by level as tables: eight more bits, all pairs of children whose
    prefixes stay within the budget, until every pair is small. Each task
    returns a spanning forest of its links, so a dense group of n values gives
    about n rows a node, not all pairs.
    """
    runs = max_distance + 1
    shifts = [BITS * i // runs for i in range(runs)]
    depth = BITS // runs
    fp = F.col("fp")
    turned = [fp if s == 0 else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, BITS - s)) for s in shifts]
    cells = fps.select("fp").distinct().select(F.posexplode(F.array(*turned)).alias("turn", "bits"))
    cells = cells.withColumn("node", _prefix("bits", depth))
    counts = cells.groupBy("turn", "node").agg(F.count("*").alias("n")).where(F.col("n") > node_rows)
    hot = cut_lineage(counts.select("turn", F.col("node").alias("a"), F.col("node").alias("b")))
    any_hot = not hot.isEmpty()
    small = cells.join(hot.select("turn", F.col("a").alias("node")), ["turn", "node"], "left_anti") if any_hot else cells
    found = [
        small.groupBy("turn", "node").agg(F.collect_list("bits").alias("left")).where(F.size("left") > 1)
        .select("turn", "left", F.array().cast("array<bigint>").alias("right"))
        .mapInPandas(_join_nodes(shifts, depth, max_distance), "a long, b long")
    ]
    while any_hot:
        deeper = min(BITS, depth + 8)
        ends = hot.select("turn", F.col("a").alias("node")).union(hot.select("turn", F.col("b").alias("node"))).distinct()
        inside = cells.withColumn("node", _prefix("bits", depth)).join(ends, ["turn", "node"], "left_semi")
        inside = cut_lineage(inside.select("turn", "bits", "node", _prefix("bits", deeper).alias("child")))
        sizes = cut_lineage(inside.groupBy("turn", "node", "child").agg(F.count("*").alias("n")))
        left = sizes.select("turn", F.col("node").alias("a"), F.col("child").alias("ca"), F.col("n").alias("na"))
        right = sizes.select("turn", F.col("node").alias("b"), F.col("child").alias("cb"), F.col("n").alias("nb"))
        own = F.col("ca") == F.col("cb")
        pairs = (
            hot.join(left, ["turn", "a"]).join(right, ["turn", "b"])
            .where(F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= max_distance)
            .where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
            .where(~own | (F.col("na") > 1))
            .select("turn", F.col("ca").alias("a"), F.col("cb").alias("b"), F.when(own, F.col("na")).otherwise(F.col("na") + F.col("nb")).alias("n"))
        )
        pairs = cut_lineage(pairs)
        depth = deeper
        leaves = pairs.where((F.col("n") <= node_rows) | F.lit(depth == BITS))
        sides = inside.join(leaves.withColumnRenamed("a", "child"), ["turn", "child"]).select(
            "turn", F.col("child").alias("a"), "b", F.col("bits").alias("l"), F.lit(None).cast("long").alias("r")
        ).union(
            inside.join(leaves.where("a != b").withColumnRenamed("b", "child"), ["turn", "child"]).select(
                "turn", "a", F.col("child").alias("b"), F.lit(None).cast("long").alias("l"), F.col("bits").alias("r")
            )
        )
        found.append(
            sides.groupBy("turn", "a", "b").agg(F.collect_list("l").alias("left"), F.collect_list("r").alias("right"))
            .select("turn", "left", "right").mapInPandas(_join_nodes(shifts, depth, max_distance), "a long, b long")
        )
        hot = pairs.where((F.col("n") > node_rows) & F.lit(depth < BITS)).select("turn", "a", "b")
        any_hot = not hot.isEmpty()
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def simhash_groups(docs: DataFrame, shingle: int = 3, max_distance: int = 2, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for every row of ``docs``.

    Reads ``doc_id`` and ``text`` only. A null text or one without words has
    fingerprint zero and is linked like any other. Equal fingerprints are one
    vertex, so any number of copies costs one row of the join. ``component_id``
    is the smallest ``doc_id`` that is not null in the component (null if there
    is none). Rows with a repeated or null ``doc_id`` each give their own row.
    An empty table gives an empty result.
    """
    return _grouped(cut_lineage(fingerprints(docs, shingle, seed)), max_distance)


def _grouped(marked: DataFrame, max_distance: int) -> DataFrame:
    """The groups of rows (``doc_id``, ``fp``) that lie in a table."""
    vertices = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(trie_links(vertices, max_distance), "a", "b").withColumnRenamed("vertex", "fp")
    rooted = vertices.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    rooted = cut_lineage(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut_lineage(rooted.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_keep(docs: DataFrame, shingle: int = 3, max_distance: int = 2, seed: int = 42, broadcast_gone: int = BROADCAST_GONE) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the smallest of their group; columns unchanged.

    A row goes by its ``doc_id`` and its own fingerprint, so another text under the same ``doc_id`` is judged by itself.
    Rows without a ``doc_id`` cannot be told apart and all stay, and so do rows of one group that share its smallest ``doc_id``.
    The rows are written with their fingerprints once; the groups and the rows that stay are both read from there.
    """
    text_at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(text_at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "__row_fp"])

    marked = cut_lineage(docs.mapInArrow(task, StructType([*docs.schema.fields, StructField("__row_fp", LongType())])))
    groups = _grouped(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__row_fp").alias("fp")), max_distance)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone_id"), F.col("fp").alias("__gone_fp")).distinct()
    gone = cut_lineage(gone)
    listed = F.broadcast(gone) if gone.count() <= broadcast_gone else gone.hint("shuffle_hash")
    same = (marked["doc_id"].cast("long") == listed["__gone_id"]) & (marked["__row_fp"] == listed["__gone_fp"])
    return marked.join(listed, same, "left_anti").drop("__row_fp")
