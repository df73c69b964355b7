import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import queries
from tidemark.llm.periodic import Grammar, periodic_runs, runs

from .documents import edge_docs, edge_rows, prose


def brute(words, least_words=6, least_periods=4):
    """(start, length, period) of all runs: every period tried over the whole text."""
    best = {}
    for p in range(1, len(words) // least_periods + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least_words, least_periods * p):
                best.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in best.items())


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng, most=300):
    words = []
    while len(words) < rng.randrange(1, 150):
        words += [f"w{rng.randrange(rng.choice([1, 2, 3, 9]))}" for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 9)
        if rng.random() < 0.3:
            words *= rng.randrange(1, 6)
        if rng.random() < 0.3:
            words = words[rng.randrange(len(words)) :]
    return words[:most]


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 5))]
        known = {}
        ids = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        expected, begin = [], 0
        for t in texts:
            expected += [(s + begin, n, p) for s, n, p in brute(t)]
            begin += len(t)
        start, end, period = runs(ids, doc)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == expected


def test_texts_whose_hashes_collide_are_compared_by_words(monkeypatch):
    # with every hash equal, only the comparison of words is left
    monkeypatch.setattr("tidemark.llm.periodic._mixed", lambda values: np.zeros(len(values), np.uint64))
    text = np.array([0, 1, 0, 1, 0, 1, 0, 1, 2, 3, 2, 3, 2, 3, 2, 3], np.int64)
    start, end, period = runs(text, np.zeros(len(text), np.int64))
    assert set(zip(start.tolist(), end.tolist(), period.tolist())) <= {(0, 8, 2), (8, 16, 2)}


def test_grammar_derives_its_text():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.tile(rng.integers(0, 40, 100), 20), rng.integers(0, 40, 3000)])
    grammar = Grammar(text, np.repeat([0, 1], [2000, 3000]))
    assert len(grammar.symbol) == 2 and grammar.size[grammar.symbol].tolist() == [2000, 3000]

    def derive(symbol):
        if symbol < grammar.words:
            return [symbol]
        return derive(grammar.left[symbol - grammar.words]) + derive(grammar.right[symbol - grammar.words])

    assert derive(grammar.symbol[0]) + derive(grammar.symbol[1]) == text.tolist()
    # the period is derived by few rules
    assert len(np.unique(np.concatenate([r for r, p in grammar.places() if len(r)]))) == len(grammar.left)
    for rules, places in grammar.places():
        for r, p in zip(rules[:50].tolist(), places[:50].tolist()):
            assert text[p : p + grammar.size[r + grammar.words]].tolist() == derive(r + grammar.words)


def test_long_texts_of_one_word_and_of_long_periods():
    ones = np.zeros(200_000, np.int64)
    assert [a.tolist() for a in runs(ones, ones)] == [[0], [200_000], [1]]
    period = np.random.default_rng(1).integers(0, 3000, 20_000)
    assert [a.tolist() for a in runs(np.tile(period, 5), np.zeros(100_000, np.int64))] == [[0], [100_000], [20_000]]


def rows_with_runs():
    rng = random.Random(4)
    rows = edge_rows() + [(3000 + i, rng.choice([" ", "\n", "\t \r"]).join(repetitive(rng))) for i in range(60)]
    rows += [(4000, "a b c " * 5), (4001, "\x1ca b " * 7), (4002, "x" + " y" * 5), (4003, " z" * 6), (4004, "same same " * 20_000)]
    return rows


def test_operator_equals_brute_force_on_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.periodic.BATCH_BYTES", 2000)
    rows = rows_with_runs()
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(edge_docs(spark, rows)).collect())
    expected = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        own = brute(words) if len(words) < 1000 else ([(0, 40_000, 1)] if i == 4004 else [])
        expected.append((str(i), len(words), own, collapsed(words, own)))
    assert got == sorted(expected)


def test_query_follows_its_contract(spark, tmp_path):
    rows = [r for r in rows_with_runs() if r[0] != 4004] + [(10_000 + i, prose(random.Random(i), 5 + i)) for i in range(200)]
    edge_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op13_periodic(spark, str(tmp_path)).collect(), key=lambda r: tuple(map(str, r)))
    expected = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        own = brute(words) if len(words) < 2000 or h % 10 == 0 else []
        best = max(own, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if own else None
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in own)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        expected.append((doc_id, len(own), *best, milli, digest(listed), digest(collapsed(words, own))))
    assert [tuple(r) for r in got] == sorted(expected, key=lambda r: tuple(map(str, r)))
    assert got[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}


def test_empty_table_and_few_periods(spark):
    assert periodic_runs(edge_docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(edge_docs(spark, []), least_periods=3)
