"""Language of a text: Viterbi over word scores, with scripts narrowing the candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.folds import thinned

WORD = re.compile(r"[^\W\d_]+")
TABLE = 1 << 16
MEMO_WORDS = 300_000
BATCH_WORDS = 2_000_000
#: First code points of blocks, and the script that begins there.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def _script(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    return SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, [ord(w[0]) for w in words], "right") - 1]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams (with the ends marked) and the hashed whole word, and which word each belongs to."""
    codes = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    begin = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        grams = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
        place = np.arange(len(codes)) - np.repeat(begin, size)
        power = np.cumprod(np.full(int(size.max()), np.uint64(0x100000001B3)), dtype=np.uint64)
        whole = np.add.reduceat(codes * power[place], begin) + np.uint64(0x5BD1E995)
        owner = np.repeat(np.arange(len(words)), size)
        inside = np.flatnonzero(place < np.repeat(size - 2, size))
        hashed = np.concatenate([grams[inside], whole])
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (hashed >> np.uint64(48)).astype(np.int64), np.concatenate([owner[inside], np.arange(len(words))])


class Model:
    """Log probabilities of hashed grams by language, and the scripts each language is written in."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.grams = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * TABLE)).T.astype(np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        written = (share >= 0.01).T
        # a script that no language is known to use leaves all of them
        self.allowed = np.where(written.any(1, keepdims=True), written, True)

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of every word in every language; a language not written in the word's script scores far below."""
        grams, owner = _grams(words)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, self.grams[grams, k], len(words))
        return np.where(self.allowed[_script(words)], out, out.min(1, keepdims=True) - 50)


def _restored(values: dict) -> Model:
    """The model again, from its broadcast values."""
    model = object.__new__(Model)
    vars(model).update(values)
    return model


def train(docs: DataFrame, docs_per_language: int = 2000) -> Model:
    """Counts grams and scripts of about ``docs_per_language`` documents of each value of ``lang`` that is not null."""

    def count(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            found: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(lang, []).extend(WORD.findall((text or "").lower()))
            langs, grams, scripts = [], [], []
            for lang, words in found.items():
                if words:
                    unique: dict[str, int] = {}
                    for w in words:
                        unique[w] = unique.get(w, 0) + 1
                    hashed, owner = _grams(list(unique))
                    n = np.array(list(unique.values()))
                    langs.append(lang)
                    grams.append(np.bincount(hashed, n[owner], TABLE).tobytes())
                    scripts.append(np.bincount(_script(list(unique)), n, len(SCRIPT_NAMES)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.binary()), pa.array(scripts, pa.binary())], ["lang", "grams", "scripts"])

    def add(table: pa.Table) -> pa.Table:
        sums = [sum(np.frombuffer(c.as_py()) for c in table.column(name)).tobytes() for name in ("grams", "scripts")]
        return pa.table({"lang": table.column("lang").slice(0, 1), "grams": pa.array([sums[0]], pa.binary()), "scripts": pa.array([sums[1]], pa.binary())})

    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null")
    schema = "lang string, grams binary, scripts binary"
    counted = thinned(known, "doc_id", "lang", docs_per_language).select("lang", "text").mapInArrow(count, schema)
    # a row of fixed size for each language
    rows = sorted(counted.groupBy("lang").applyInArrow(add, schema).collect(), key=lambda r: r["lang"])
    tables = [np.array([np.frombuffer(r[name]) for r in rows]).reshape(len(rows), n) for name, n in (("grams", TABLE), ("scripts", len(SCRIPT_NAMES)))]
    return Model([r["lang"] for r in rows], *tables)


def viterbi(scores: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word of many texts at once, each change of language costing ``penalty``.

    ``scores`` has the words of all texts one after another, ``size`` the
    number of words of each. Texts are walked side by side, the longest first,
    so that those still going on are a leading part at every step.
    """
    order = np.argsort(-size, kind="stable")
    begin = (np.cumsum(size) - size)[order]
    length = size[order]
    # the smallest integers that number the languages
    kind = np.min_scalar_type(-scores.shape[1] - 1)
    best = np.empty(len(scores), kind)
    steps = int(length.max(initial=0))
    going = np.searchsorted(-length, -np.arange(steps), "left")
    level = np.zeros((len(size), scores.shape[1]), np.float32)
    for t in range(steps):
        here = begin[: going[t]] + t
        now = level[: going[t]]
        if t:
            top = now.argmax(1)
            change = now[np.arange(len(now)), top] - penalty
            stays = now >= change[:, None]
            back[here] = np.where(stays, np.arange(now.shape[1], dtype=kind), top[:, None].astype(kind))
            now = np.where(stays, now, change[:, None])
        else:
            back = np.zeros(scores.shape, kind)
        now = now + scores[here]
        # differences decide; the level itself would grow with the text
        level[: going[t]] = now - now.max(1, keepdims=True)
    state = level.argmax(1) if len(size) else np.empty(0, np.int64)
    for t in range(steps - 1, -1, -1):
        here = begin[: going[t]] + t
        best[here] = state[: going[t]]
        state[: going[t]] = back[here, state[: going[t]]]
    return best


def _labelled(texts: list[str | None], model: Model, memo: dict[str, int], table: list[np.ndarray], penalty: float):
    """Language numbers and words of some texts, one after another, and the number of words of each."""
    words = [WORD.findall((t or "").lower()) for t in texts]
    new = list({w for some in words for w in some if w not in memo})
    if len(memo) + len(new) > MEMO_WORDS:
        memo.clear()
        table.clear()
        new = list({w for some in words for w in some})
    if new:
        memo.update(zip(new, range(len(memo), len(memo) + len(new))))
        table.append(model.scores(new))
    size = np.array([len(w) for w in words], np.int64)
    flat = [w for some in words for w in some]
    if not flat:
        return np.empty(0, np.int8), flat, size
    known = np.concatenate(table)
    table[:] = [known]
    at = np.fromiter((memo[w] for w in flat), np.int64, len(flat))
    return viterbi(known[at], size, penalty), flat, size


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size together; a longer text is a range of its own."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text or "") > 6 * BATCH_WORDS:
            yield first, k
            first, held = k, 0
        held += len(text or "")
    if first < len(texts):
        yield first, len(texts)


def keep_known(docs: DataFrame, model: Model, least_share: float = 0.0, penalty: float = 12.0) -> DataFrame:
    """The rows of ``docs`` whose language is found, in at least ``least_share`` of their letters; columns unchanged.

    Rows are judged where they lie, so nothing is joined or shuffled. Rows
    that ``languages`` calls ``und`` go. With a model that has learned no
    language all rows with a letter stay.
    """
    kept = docs.sparkSession.sparkContext.broadcast(vars(model))

    def task(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo, table = _restored(kept.value), {}, []
        for batch in arrived:
            texts = batch.column("text").to_pylist()
            known = [] if model.langs else [WORD.search(t or "") is not None for t in texts]
            for a, b in _parts(texts if model.langs else []):
                known += [share >= least_share and pred != "und" for pred, share, _ in _judged(texts[a:b], model, memo, table, penalty)]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def _judged(texts: list[str | None], model: Model, memo: dict[str, int], table: list[np.ndarray], penalty: float) -> Iterator[tuple[str, float, np.ndarray]]:
    """Language, share of letters and languages of the words of every text."""
    count = len(model.langs)
    if not count:
        for _ in texts:
            yield "und", 0.0, np.empty(0, np.int8)
        return
    best, words, size = _labelled(texts, model, memo, table, penalty)
    letters = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(texts)), size)
    held = np.bincount(owner * count + best, letters, len(texts) * count).reshape(len(texts), count)
    total, top = held.sum(1), held.argmax(1)
    share = held.max(1) / np.maximum(total, 1)
    for k, own in enumerate(np.split(best, np.cumsum(size)[:-1])):
        yield (model.langs[top[k]] if total[k] else "und"), float(share[k]), own


def languages(docs: DataFrame, model: Model, penalty: float = 12.0, with_spans: bool = False) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and, if asked for, ``spans`` for every row of ``docs``.

    Reads ``doc_id`` and ``text`` only. ``spans`` are runs of words of one
    language, as "lang:words". The prediction is the language with the most
    letters in its spans, ``score`` its share of all letters; of equal ones the
    first by name. A text that is null or has no letter is ``und``, score 0. With a
    model that has learned no language every text is ``und``.
    """
    kept = docs.sparkSession.sparkContext.broadcast(vars(model))

    def task(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo, table = _restored(kept.value), {}, []
        for batch in arrived:
            texts = batch.column("text").to_pylist()
            preds, scores, spans = [], [], []
            for a, b in _parts(texts):
                for pred, share, own in _judged(texts[a:b], model, memo, table, penalty):
                    preds.append(pred)
                    scores.append(share)
                    if with_spans:
                        edges = np.flatnonzero(np.diff(own, prepend=-1))
                        spans.append([f"{model.langs[own[e]]}:{n}" for e, n in zip(edges, np.diff(np.append(edges, len(own))))])
            columns = [batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.string())))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, lang_pred string, score double" + ", spans array<string>" * with_spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, schema)
