"""Best-fit packing of tokenized documents into sequences of equal length, by sum of squares."""

from __future__ import annotations

import math
import os
import re
import struct
import sys
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.session import cut_lineage

#: Texts cut where the tokenizer always begins a new unit: around words of Latin letters, and between words and white space.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
UNIT = re.compile(rf" ?[{LATIN}]++(?![^\W\d_])| ?\S+|\s+(?!\S)|\s")
#: Separators that Python takes for white space and the tokenizer does not: such texts are encoded whole, too.
ODD = "\x1c\x1d\x1e\x1f"
#: A whole unit of the tokenizer, which its model takes without cutting it again.
WORD = re.compile(rf" ?[{LATIN}]+")
MEMO_ENTRIES = 600_000


def _byte_signs() -> dict[int, str]:
    """The signs that byte-level models read for bytes: printed ones stand for themselves, the others follow from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) if b in printed else chr(256 + others.index(b)) for b in range(256)}


BYTE_SIGNS = _byte_signs()


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by a byte-level BPE; units met before are looked up.

    The tokenizer and the units are kept on the ``sys`` module, by path, for
    all tasks that one Python worker runs. Texts that hold an added token of the
    tokenizer, which it cuts out before all else, are encoded whole.
    """

    def __init__(self, path: str):
        # tasks already run side by side on every core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # functions travel by value, so their globals end with the task; what is hung on the interpreter serves the worker's next tasks
        kept = vars(sys).setdefault("_tidemark_ids", {})
        if path not in kept:
            tokenizer = Tokenizer.from_file(path)
            added = sorted(t.content for t in tokenizer.get_added_tokens_decoder().values())
            kept[path] = (tokenizer, {}, [*ODD, *added])
        self.tokenizer: Tokenizer = kept[path][0]
        self.memo: dict[str, bytes] = kept[path][1]
        self.whole: list[str] = kept[path][2]

    def __call__(self, text: str) -> bytes:
        # looking for each sign by itself is faster than a pattern of all
        if any(sign in text for sign in self.whole):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        units = UNIT.findall(text)
        memo = self.memo
        known = list(map(memo.get, units))
        if None not in known:
            return b"".join(known)
        new = {u for u, ids in zip(units, known) if ids is None}
        if len(memo) + len(new) > MEMO_ENTRIES:
            # the older half goes
            for unit in list(islice(memo, MEMO_ENTRIES // 2)):
                del memo[unit]
            new = [u for u in set(units) if u not in memo]
        tokens, others = self.tokenizer.model.tokenize, []
        for unit in new:
            if WORD.fullmatch(unit):
                ids = [t.id for t in tokens(unit.encode().decode("latin-1").translate(BYTE_SIGNS))]
                memo[unit] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(unit)
        for unit, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else ()):
            memo[unit] = struct.pack(f"<{len(found.ids)}I", *found.ids)
        return b"".join(map(memo.__getitem__, units))


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` (bytes) of every row.

    A document's ids end with ``end_id``. One of more than ``length`` ids is
    cut so that all pieces but the first are full.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column("text")):
                ids = encode(text.as_py() or "") + end
                first = len(ids) % (4 * length) or min(len(ids), 4 * length)
                cuts = [0, *range(first, len(ids) + 1, 4 * length)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[a:b]
                    rows.append(row)
                    out.append((n, a // 4, (b - a) // 4, zlib.crc32(part)) + (part,) * with_ids)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
            found = [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)]
            if out:
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), *found], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, schema)


def _sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item in turn, and the gap that each bin is left with.

    With n(g) open bins of gap g, an item goes into the open bin with room for
    it that makes the sum of n(g)^2 smallest; of equal ones into the fullest. A
    new bin is opened only if there is none: with the longest items first this
    comes within a few bins of the total length, where opening bins whenever
    that makes the sum smaller needs one in a hundred more.
    """
    count = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    far = np.iinfo(np.int64).max
    for k, size in enumerate(sizes.tolist()):
        here = count[size:capacity]
        # change of the sum: 2 (n(g - size) - n(g) + 1); a bin that becomes full only leaves: 1 - 2 n(g)
        change = np.where(here > 0, 2 * (count[: capacity - size] - here + 1), far)
        if len(change) and here[0]:
            change[0] = 1 - 2 * here[0]
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] < far:
            gap = best + size
            place = waiting[gap].pop()
            count[gap] -= 1
        else:
            gap, place = capacity, len(gaps)
            gaps.append(capacity)
        bins[k], offsets[k] = place, capacity - gap
        gaps[place] = gap - size
        if gap > size:
            waiting[gap - size].append(place)
            count[gap - size] += 1
    return bins, offsets, np.array(gaps, np.int64)


def _fill(capacity: int, turn: int):
    """Task: packs the items of one partition; the bins are numbered by turn, partition and place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [b for b in batches if b.num_rows]
        if not items:
            return
        # any order of arrival gives the same bins
        table = pa.Table.from_batches(items)
        rest = [c for c in table.column_names if c not in ("size", "ids")]
        table = table.sort_by([(c, "descending") for c in ["size", *rest]])
        bins, offsets, gaps = _sum_of_squares(table.column("size").to_numpy(), capacity)
        number = (turn << 56) + (TaskContext.get().partitionId() << 32)
        for name, values in (("bin", bins + number), ("offset", offsets), ("gap", gaps[bins])):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches()

    return task


def _packed(items: DataFrame, keys: list[str], capacity: int, tasks: int, turn: int) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return cut_lineage(items.repartition(tasks, *keys).mapInArrow(_fill(capacity, turn), f"{kinds}, bin long, offset long, gap long"))


def pack(items: DataFrame, capacity: int = 2048, items_per_task: int = 100_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to items of ``length`` 1 to ``capacity``.

    Full items are sequences of their own. The others are dealt by hash to
    tasks of about ``items_per_task`` (a bound on memory, not on what is
    packed), each of which packs its share. Bins that are left with a gap go on
    as single items into fewer tasks, until one task sees all that is still
    open or their number no longer falls. ``items_per_task`` does not depend
    on the lengths, so the open bins a task leaves weigh little.
    """
    spread = [c for c in items.columns if c != "ids"]
    tasks = max(1, math.ceil(items.count() / items_per_task))
    rest = items.withColumn("size", F.col("length"))
    done = _packed(rest, spread, capacity, tasks, 0)
    place = None
    turn, open_bins = 1, done.where("gap > 0").select("bin", (capacity - F.col("gap")).alias("size")).distinct()
    waiting = open_bins.count()
    while tasks > 1 and waiting:
        fewer = max(1, math.ceil(waiting / items_per_task))
        if fewer >= tasks:
            break
        merged = _packed(open_bins.withColumnRenamed("bin", "part"), ["part"], capacity, fewer, turn)
        moved = merged.select(F.col("part"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        if place is None:
            place = moved
        else:
            behind = place.join(moved.select(F.col("part").alias("to"), F.col("to").alias("next"), F.col("by").alias("more")), "to", "left")
            later = behind.select("part", F.coalesce("next", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
            place = cut_lineage(later)
        open_bins = merged.where("gap > 0").select("bin", (capacity - F.col("gap")).alias("size")).distinct()
        tasks, turn, waiting = fewer, turn + 1, open_bins.count()
    done = done.drop("size", "gap")
    if place is None:
        return done.withColumnRenamed("bin", "sequence_id")
    done = done.join(place, done["bin"] == place["part"], "left")
    moved_to = F.coalesce("to", "bin").alias("sequence_id")
    return done.select(*items.columns, moved_to, (F.col("offset") + F.coalesce("by", F.lit(0))).cast("long").alias("offset"))


def packed_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, items_per_task: int = 100_000, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with the sequence and the offset they are packed at.

    Reads ``doc_id`` and ``text`` only. A null or empty text is a piece that
    has the end id alone. Rows that are repeated, or share or lack a
    ``doc_id``, are packed one by one. An empty table gives an empty result.
    """
    cut = cut_lineage(pieces(docs, tokenizer, length, end_id, with_ids))
    full = cut.where(F.col("length") == length)
    # numbers below zero: they meet none of the bins
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    packed = pack(cut.where(F.col("length") < length), length, items_per_task)
    return packed.select(*alone.columns).union(alone)
