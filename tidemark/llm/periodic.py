"""Periodic runs of words: a Re-Pair grammar, runs across the middle of each rule once, and every place the rule derives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mixed(values: np.ndarray) -> np.ndarray:
    """64 hash bits of each number."""
    with np.errstate(over="ignore"):
        x = (values.astype(np.uint64) + np.uint64(1)) * BASE
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _lengths(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def stretches(ids: np.ndarray, doc: np.ndarray, least_words: int, least_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words in which all runs lie.

    A run of k periods holds each pair of its neighbours k - 1 times or more,
    so a pair that its stretch holds less often belongs to no run and cuts it.
    That is repeated while it cuts; a stretch too short for a run goes.
    """
    at = np.flatnonzero(doc[1:] == doc[:-1])
    part = doc[at]
    _, pair, count = np.unique(ids[at] * (int(ids.max(initial=0)) + 1) + ids[at + 1], return_inverse=True, return_counts=True)
    kept = count[pair] >= least_periods - 1
    pairs = len(count)
    while True:
        at, part, pair = at[kept], part[kept], pair[kept]
        begins = np.ones(len(at), bool)
        begins[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(begins) - 1
        size = np.bincount(part)
        kept = size[part] >= least_words - 1
        if kept.all():
            _, own, count = np.unique(part * pairs + pair, return_inverse=True, return_counts=True)
            kept = count[own] >= least_periods - 1
            if kept.all():
                begin = at[begins]
                return begin, begin + size + 1


class Grammar:
    """Rules of two symbols that derive a text cut into parts; words are the symbols below ``words``.

    In every round the pairs that come more often give way to none, the most
    frequent ones first: a pair is replaced where it is ahead of the pairs it
    overlaps. So many pairs are replaced in one pass. When no pair comes twice
    the symbols left of each part are joined in halves.
    """

    def __init__(self, text: np.ndarray, part: np.ndarray):
        self.words = int(text.max(initial=-1)) + 1
        self.left, self.right = np.empty(0, np.int64), np.empty(0, np.int64)
        self.size = np.ones(self.words, np.int64)
        #: where each rule's first replaced pair lies in the text
        self.first = np.empty(0, np.int64)
        self.symbol, self.place, self.part = text, np.arange(len(text)), part
        while self._replace_frequent():
            pass
        while self._replace_halves():
            pass

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        joint = np.flatnonzero(self.part[1:] == self.part[:-1])
        return joint, self.symbol[joint] * len(self.size) + self.symbol[joint + 1]

    def _replace(self, chosen: np.ndarray, key: np.ndarray) -> None:
        _, first, new = np.unique(key, return_index=True, return_inverse=True)
        origin = chosen[first]
        left, right = self.symbol[origin], self.symbol[origin + 1]
        self.left, self.right = np.append(self.left, left), np.append(self.right, right)
        self.first = np.append(self.first, self.place[origin])
        self.symbol = self.symbol.copy()
        self.symbol[chosen] = len(self.size) + new
        self.size = np.append(self.size, self.size[left] + self.size[right])
        kept = np.ones(len(self.symbol), bool)
        kept[chosen + 1] = False
        self.symbol, self.place, self.part = self.symbol[kept], self.place[kept], self.part[kept]

    def _replace_frequent(self) -> bool:
        joint, key = self._pairs()
        pairs, pair, count = np.unique(key, return_inverse=True, return_counts=True)
        if not (count > 1).any():
            return False
        # frequencies to a power of two, then a hash: rounds stay logarithmic whatever the text
        order = np.lexsort((_mixed(pairs), np.frexp(count)[1]))
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(1, len(pairs) + 1)
        rank[count < 2] = 0
        ahead = np.zeros(len(self.symbol) + 1, np.int64)
        ahead[joint + 1] = rank[pair]
        # neighbouring pairs of one rank are one symbol repeated: every other one is replaced
        edges = np.flatnonzero(np.diff(ahead, prepend=-1))
        value = ahead[edges]
        around = np.zeros(len(value) + 2, np.int64)
        around[1:-1] = value
        top = (value > around[:-2]) & (value > around[2:])
        chain = np.diff(np.append(edges, len(ahead)))
        inside = _lengths(chain)
        chosen = np.flatnonzero(np.repeat(top, chain) & (inside % 2 == 0)) - 1
        self._replace(chosen, self.symbol[chosen] * len(self.size) + self.symbol[chosen + 1])
        return True

    def _replace_halves(self) -> bool:
        joint, key = self._pairs()
        if not len(joint):
            return False
        begins = np.flatnonzero(np.diff(self.part, prepend=-1))
        inside = _lengths(np.diff(np.append(begins, len(self.part))))
        even = inside[joint] % 2 == 0
        self._replace(joint[even], key[even])
        return True

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rules, where they begin) of all places the rules derive, level by level."""
        rule, place = self.symbol - self.words, self.place
        while (rule >= 0).any():
            rule, place = rule[rule >= 0], place[rule >= 0]
            yield rule, place
            left = self.left[rule]
            rule = np.concatenate([left, self.right[rule]]) - self.words
            place = np.concatenate([place, place + self.size[left]])


class Hashes:
    """Prefix polynomial hashes: whether two substrings are equal, but for collisions."""

    def __init__(self, text: np.ndarray):
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.append(np.uint64(1), np.full(len(text), BASE)), dtype=np.uint64)
            self.prefix = np.append(np.uint64(0), np.cumsum(_mixed(text) * self.power[:-1], dtype=np.uint64))

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For b after a."""
        with np.errstate(over="ignore"):
            return (self.prefix[a + size] - self.prefix[a]) * self.power[b - a] == self.prefix[b + size] - self.prefix[b]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How far, up to ``most``, the text goes on alike from a and b: forwards, or backwards for ``way`` -1."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            back = middle if way < 0 else 0
            alike = self.same(a - back, b - back, middle)
            low, high = np.where(alike, middle, low), np.where(alike, high, middle - 1)
        return low


def _least_period(own: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Indexes of the smallest period of every (own, start, end)."""
    order = np.lexsort((period, end, start, own))
    new = np.ones(len(order), bool)
    for key in (own, start, end):
        new[1:] &= key[order][1:] == key[order][:-1]
    new[1:] = ~new[1:]
    return order[new]


def crossing(text: np.ndarray, grammar: Grammar, least_words: int, least_periods: int) -> tuple[np.ndarray, ...]:
    """(rule, start, end, period) of the runs across the middle of each rule, looked for where it comes first.

    Of four periods or more, two lie on one side of the middle, so the two
    stretches of one period before it or after it are equal.
    """
    hashes = Hashes(text)
    begin = grammar.first
    size = grammar.size[grammar.words :]
    middle, end = begin + grammar.size[grammar.left], begin + size
    tries = np.where(size >= least_words, size // least_periods, 0)
    upto = np.cumsum(tries)
    parts = []
    for low in range(0, int(upto[-1]) if len(upto) else 0, CHUNK):
        flat = np.arange(low, min(low + CHUNK, int(upto[-1])))
        rule = np.searchsorted(upto, flat, "right")
        period = flat - (upto - tries)[rule] + 1
        m = middle[rule]
        for side in (0, 1):
            # the first word on that side and the one a period on
            near, far = (m, m + period) if side else (m - 1, m - 1 - period)
            anchor = m if side else m - 2 * period
            inside = m + 2 * period <= end[rule] if side else anchor >= begin[rule]
            k = np.flatnonzero(inside)
            k = k[text[near[k]] == text[far[k]]]
            k = k[hashes.same(anchor[k], anchor[k] + period[k], period[k])]
            r, p, a = rule[k], period[k], anchor[k]
            last = a + p + hashes.common(a, a + p, end[r] - a - p, 1)
            start = a - hashes.common(a, a + p, a - begin[r], -1)
            long = (last - start >= np.maximum(least_words, least_periods * p)) & (start < m[k]) & (last > m[k])
            parts.append((r[long], start[long], last[long], p[long]))
    rule, start, last, period = map(np.concatenate, zip(*parts)) if parts else [np.empty(0, np.int64)] * 4
    best = _least_period(rule, start, last, period)
    return rule[best], start[best], last[best], period[best]


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """Intervals of one period that share at least a period become one."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    level = np.cumsum(np.diff(period, prepend=0) != 0) * (reach + 1)
    furthest = np.maximum.accumulate(end + level)
    new = np.ones(len(start), bool)
    new[1:] = (start + level)[1:] > furthest[:-1] - period[1:]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], (furthest - level)[last], period[first]


def _verified(text: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray, least_words: int, least_periods: int) -> tuple[np.ndarray, ...]:
    """The intervals after their words are compared; one whose hashes lied falls to the parts that hold."""
    sound, found = np.ones(len(start), bool), []
    for k in range(len(start)):
        s, e, p = int(start[k]), int(end[k]), int(period[k])
        alike = text[s : e - p] == text[s + p : e]
        if not alike.all():
            sound[k] = False
            edges = np.flatnonzero(np.diff(np.concatenate([[False], alike, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a + p >= max(least_words, least_periods * p):
                    found.append((s + a, s + b + p, p))
    more = np.array(found, np.int64).reshape(-1, 3).T
    return tuple(np.append(old[sound], new) for old, new in zip((start, end, period), more))


def runs(ids: np.ndarray, doc: np.ndarray, least_words: int = 6, least_periods: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all maximal runs in the documents ``doc`` of words ``ids``, by start, then period."""
    begin, end = stretches(ids, doc, least_words, least_periods)
    size = end - begin
    inside = np.repeat(begin, size) + _lengths(size)
    text = ids[inside]
    grammar = Grammar(text, np.repeat(np.arange(len(size)), size))
    rule, start, last, period = crossing(text, grammar, least_words, least_periods)
    # the rules' runs stand together
    held = np.bincount(rule, minlength=len(grammar.left))
    upto = np.cumsum(held) - held
    parts = []
    for rules, place in grammar.places():
        take = np.repeat(upto[rules], held[rules]) + _lengths(held[rules])
        shift = np.repeat(place - grammar.first[rules], held[rules])
        parts.append((start[take] + shift, last[take] + shift, period[take]))
    if not len(rule):
        return (np.empty(0, np.int64),) * 3
    start, last, period = _merged(*map(np.concatenate, zip(*parts)), len(text))
    start, last, period = _verified(text, start, last, period, least_words, least_periods)
    best = _least_period(np.zeros_like(start), start, last, period)
    start, last, period = start[best], last[best], period[best]
    order = np.lexsort((period, start))
    start, last, period = start[order], last[order], period[order]
    return inside[start], inside[last - 1] + 1, period


def _batches(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size together; a longer text is a range of its own."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text or b"") > BATCH_BYTES:
            yield first, k
            first, held = k, 0
        held += len(text or b"")
    if first < len(texts):
        yield first, len(texts)


def _judged(texts: list[bytes | None], least_words: int, least_periods: int) -> Iterator[tuple[int, list[dict], bytes]]:
    """Number of words, runs and collapsed text of each text."""
    # bytes are cut at the ASCII white space, and nowhere else
    words = [(t or b"").split() for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for some in words for w in some), np.int64, int(size.sum()))
    doc = np.repeat(np.arange(len(words)), size)
    start, end, period = runs(ids, doc, least_words, least_periods)
    owner = doc[start]
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    gone = np.cumsum(gone)[:-1] > 0
    begin = np.cumsum(size) - size
    bounds = np.searchsorted(owner, np.arange(len(words) + 1))
    for k, some in enumerate(words):
        a, b = int(bounds[k]), int(bounds[k + 1])
        own = [{"start": int(s - begin[k]), "length": int(e - s), "period": int(p)} for s, e, p in zip(start[a:b], end[a:b], period[a:b])]
        if own:
            some = [w for w, g in zip(some, gone[begin[k] : begin[k] + size[k]].tolist()) if not g]
        yield int(size[k]), own, b" ".join(some)


def periodic_runs(docs: DataFrame, least_words: int = 6, least_periods: int = 4) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` of every row of ``docs``.

    Reads ``doc_id`` and ``text`` only. Words are what stands between ASCII
    white space, numbered from 0. A run is a stretch of at least
    ``least_words`` words and ``least_periods`` of its smallest period (four at
    least) that no neighbouring word extends. ``collapsed`` joins the words
    that no run holds after its first period by one space. A null, empty or
    blank text has no words, no runs and an empty ``collapsed``. Rows that
    share or lack a ``doc_id`` give a row each; an empty table gives an empty
    result. Documents are judged where they lie: nothing is shuffled, and a
    task holds a few megabytes of text at a time, or one longer document.
    """
    if least_periods < 4:
        raise ValueError("least_periods must be 4 or more")

    def task(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            # a cast of text to its bytes copies nothing
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in _batches(texts):
                size, own, collapsed = zip(*_judged(texts[a:b], least_words, least_periods))
                columns = [pa.array(size, pa.int64()), pa.array(own, pa.list_(RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], ["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, schema)
