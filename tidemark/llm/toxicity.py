"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
SPACE = 1 << 20
PREFIXES = (3, 4, 5, 6)
MEMO_WORDS = 500_000


def _terms(word: str) -> list[int]:
    """Hashed word and word beginnings."""
    return [zlib.crc32(word.encode()) % SPACE] + [zlib.crc32(f"{word[:n]}*".encode()) % SPACE for n in PREFIXES if len(word) > n]


class Model:
    """Learned terms with a weight and a vector of factors each; terms that are not among them weigh nothing."""

    def __init__(self, terms: np.ndarray, bias: float, weight: np.ndarray, factors: np.ndarray):
        self.bias, self.weight, self.factors = bias, weight, factors
        self.place = dict(zip(terms.tolist(), range(len(terms))))
        self.memo: dict[str, tuple[int, ...]] = {}

    def found(self, text: str | None) -> list[int]:
        """Places of the learned terms in a text, each once."""
        memo, out = self.memo, set()
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in set(WORD.findall((text or "").lower())):
            places = memo.get(word)
            if places is None:
                places = memo[word] = tuple(self.place[t] for t in _terms(word) if t in self.place)
            if places:
                out.update(places)
        return sorted(out)

    def score(self, text: str | None) -> float:
        at = np.array(self.found(text), np.int64)
        sums = self.factors[at].sum(0)
        pairs = 0.5 * float((sums**2 - (self.factors[at] ** 2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[at].sum() + pairs, -500, 500))))


def fit(present: np.ndarray, label: np.ndarray, factors: int = 4, rounds: int = 200, rate: float = 0.05, decay: float = 1e-3, seed: int = 5):
    """Bias, weights and factors of a factorization machine with logistic loss, by Adam over all rows."""
    rng = np.random.default_rng(seed)
    n, m = present.shape
    share = (label.sum() + 0.5) / (n + 1)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(m), rng.normal(0, 0.05, (m, factors))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        bias, weight, v = params
        sums = present @ v
        raw = bias + present @ weight + 0.5 * (sums**2 - present @ v**2).sum(1)
        off = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - label) / n
        back = present.T @ off
        slopes = [np.array([off.sum()]), back + decay * weight / n**0.5, present.T @ (off[:, None] * sums) - back[:, None] * v + decay * v / n**0.5]
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def thinned_terms(present: np.ndarray, label: np.ndarray, copies: int = 2, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The rows, and copies of the toxic ones that keep half of their terms, as a new form of a known word does."""
    rng = np.random.default_rng(seed)
    toxic = np.repeat(present[label == 1], copies, axis=0)
    toxic = toxic * (rng.random(toxic.shape) < 0.5)
    toxic = toxic[toxic.any(1)].astype(present.dtype)
    return np.concatenate([present, toxic]), np.concatenate([label, np.ones(len(toxic))])


def thinned_cells(cells: list[np.ndarray], label: np.ndarray, copies: int = 2, seed: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """As ``thinned_terms``, of rows given by the places of their terms."""
    rng = np.random.default_rng(seed)
    more = [c[rng.random(len(c)) < 0.5] for c, toxic in zip(cells, label) if toxic for _ in range(copies)]
    more = [c for c in more if len(c)]
    return cells + more, np.concatenate([label, np.ones(len(more))])


def fit_all(cells: list[np.ndarray], label: np.ndarray, start: tuple, size: int, rounds: int = 10, batch: int = 256, rate: float = 0.03, pulls: tuple[float, float] = (3.0, 20.0), shrink: float = 1.0, seed: int = 5):
    """Bias, weights and factors of all ``size`` terms, by AdaGrad over the rows in batches, each the places of its terms.

    ``start`` has the bias, and places, weights and factors of the terms that are known already. Weights and factors are
    drawn to where they start: all others at no weight and small factors, so that a pair is learned whatever its terms do alone.
    Small samples take more rounds, for 400 batches in all. ``pulls`` of weights and factors and the ``shrink`` of weights
    were chosen on rows of the sample that were left out of the fit, by their logistic loss.
    """
    rng = np.random.default_rng(seed)
    n, (bias, known, weight, factors) = len(cells), start
    params = np.zeros((size, 1 + factors.shape[1]))
    params[known] = np.column_stack([weight, factors])
    home = params.copy()
    params[:, 1:] += (params[:, 1:] == 0) * rng.normal(0, 0.01, (size, factors.shape[1]))
    seen, bias_seen, pull = np.ones_like(params), 1.0, np.array([pulls[0]] + [pulls[1]] * factors.shape[1])
    for _ in range(max(rounds, -(-400 * batch // n))):
        order = rng.permutation(n)
        for first in range(0, n, batch):
            rows = order[first : first + batch]
            own = [cells[i] for i in rows]
            owner = np.repeat(np.arange(len(rows)), [len(c) for c in own])
            used, place = np.unique(np.concatenate(own), return_inverse=True)
            now = params[used]
            v = now[place, 1:]
            sums = np.column_stack([np.bincount(owner, column, len(rows)) for column in v.T])
            raw = bias + np.bincount(owner, now[place, 0], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(owner, (v**2).sum(1), len(rows)))
            off = 1 / (1 + np.exp(-np.clip(raw, -500, 500))) - label[rows]
            bias_seen += off.sum() ** 2
            bias -= rate * off.sum() / bias_seen**0.5
            back = np.bincount(place, off[owner], len(used))
            slopes = np.column_stack([back] + [np.bincount(place, (off[:, None] * sums)[owner, f], len(used)) - back * now[:, f + 1] for f in range(v.shape[1])])
            slopes += pull * (now - home[used]) * len(rows) / n
            seen[used] += slopes**2
            pace = rate / np.sqrt(seen[used])
            moved = now - home[used] - pace * slopes
            moved[:, 0] = np.sign(moved[:, 0]) * np.maximum(0, np.abs(moved[:, 0]) - pace[:, 0] * shrink * len(rows) / n)
            params[used] = home[used] + moved
    return float(bias), params[:, 0], params[:, 1:]


def _choose(terms: np.ndarray, owner: np.ndarray, label: np.ndarray, most: int, least: float) -> np.ndarray:
    """Terms that go with the label most clearly, by the signed root of the chi-squared statistic."""
    n, positive = len(label), label.sum()
    held = np.bincount(terms, minlength=SPACE).astype(np.float64)
    both = np.bincount(terms, label[owner], SPACE)
    expected = held * positive / max(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        signed = (both - expected) / np.sqrt(expected * (1 - positive / n) * (1 - held / n))
    signed = np.where(held >= 3, np.nan_to_num(signed, posinf=0, neginf=0), 0)
    ranked = np.argsort(-np.abs(signed), kind="stable")[:most]
    return ranked[np.abs(signed[ranked]) >= least]


def _restored(values: dict) -> Model:
    """The model again, from its broadcast values."""
    model = object.__new__(Model)
    vars(model).update(values)
    return model


def train(labelled: DataFrame, start_terms: int = 512, least_rows: int = 3, factors: int = 4) -> Model:
    """Learns from ``text`` and ``label`` (0 or 1) of a bounded sample of rows, as ``bounded_labels`` draws it.

    The rows are hashed into terms where they lie; the terms of the sample are
    fitted in one task: first the ``start_terms`` at most that go with the label by
    themselves, and from there all that ``least_rows`` rows hold, together.
    Rows with a null label are left out.
    """

    def hashed(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            cells = []
            for text in batch.column("text"):
                words = set(WORD.findall((text.as_py() or "").lower()))
                cells.append(np.unique(np.array([t for w in words for t in _terms(w)], "<i4")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(cells, pa.binary())], ["doc_id", "label", "terms"])

    def learn(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(arrived, pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.binary())])).sort_by("doc_id")
        label = rows.column("label").to_numpy().astype(np.float64)
        cells = [np.frombuffer(c.as_py(), "<i4") for c in rows.column("terms")]
        if not len(cells):
            return
        owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        terms = np.concatenate(cells)
        clear = np.sort(_choose(terms, owner, label, start_terms, 6.0))
        place = np.searchsorted(clear, terms)
        known = (place < len(clear)) & (clear[np.minimum(place, max(len(clear) - 1, 0))] == terms) if len(clear) else np.zeros(len(terms), bool)
        present = np.zeros((len(cells), len(clear)), np.float32)
        present[owner[known], place[known]] = 1
        bias, weight, v = fit(*thinned_terms(present, label), factors)
        chosen = np.union1d(clear, np.flatnonzero(np.bincount(terms, minlength=SPACE) >= least_rows))
        if len(chosen):
            at = np.full(SPACE, -1, np.int32)
            at[chosen] = np.arange(len(chosen))
            cells = [places[places >= 0] for places in (at[c] for c in cells)]
            bias, weight, v = fit_all(*thinned_cells(cells, label), (bias, at[clear], weight, v), len(chosen))
        parts = [chosen.astype("<i8").tobytes(), np.array([bias]).tobytes(), weight.tobytes(), v.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["terms", "bias", "weight", "factors"])

    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label")).where("label is not null")
    cells = rows.mapInArrow(hashed, "doc_id long, label int, terms binary")
    model = cells.repartition(1).mapInArrow(learn, "terms binary, bias binary, weight binary, factors binary").first()
    if model is None:
        return Model(np.empty(0, np.int64), 0.0, np.empty(0), np.empty((0, factors)))
    return Model(np.frombuffer(model["terms"], "<i8"), float(np.frombuffer(model["bias"])[0]), np.frombuffer(model["weight"]), np.frombuffer(model["factors"]).reshape(-1, factors))


def bounded_labels(labels: DataFrame, label: str, most_rows: int = 12_000, seed: int = 3) -> DataFrame:
    """``doc_id`` and ``label`` of at most ``most_rows`` labelled rows, the first by a hash of ``doc_id``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label").limit(most_rows)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``docs``; reads ``doc_id`` and ``text`` only.

    Whole texts are scored; a null or empty text, or one without a learned term,
    has the score of the bias. A model that has learned nothing gives 0.5.
    """
    kept = docs.sparkSession.sparkContext.broadcast(vars(model))

    def task(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _restored(kept.value)
        for batch in arrived:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double")
