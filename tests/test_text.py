import math
import random

import numpy as np
import pytest

from tidemark.operators import corpus as D
from tidemark.operators import search as S
from tidemark.operators.chunking import chunk_documents, window
from tidemark.operators.vectors import VectorIndex, vector_topk
from pyspark.sql import functions as F


def python_chunks(text, size=128, stride=116):
    words = text.split()
    return [(i, min(i + size, len(words)), " ".join(words[i : i + size])) for i in range(0, len(words), stride)]


def test_chunks(frame):
    texts = {1: " ".join(f"w{i}" for i in range(300)), 2: "  ", 3: "one two", 4: " ".join("x" for _ in range(116)), 5: " ".join("y" for _ in range(117))}
    df = frame(list(texts.items()), "doc_id int, text string")
    found = {}
    for r in chunk_documents(df).orderBy("doc_id", "chunk_no").collect():
        found.setdefault(r["doc_id"], []).append((r["start_idx"], r["end_idx"], r["text"]))
    assert found == {i: python_chunks(t) for i, t in texts.items() if t.split()}
    with pytest.raises(ValueError):
        window(40, 40)


def brute_force(documents, queries, k):
    """One query at a time over all chunks."""
    results = {}
    chunked = {d: [c[2] for c in python_chunks(t)] for d, t in documents.items()}
    for q, text in queries.items():
        words = text.lower().split()
        terms = set(words)
        for w in words:
            terms.update(S.TRANSLATIONS.get(w.strip(S.QUERY_PUNCTUATION), []))
        if not terms:
            continue
        tokens = {d: [set(c.lower().split()) for c in cs] for d, cs in chunked.items()}
        frequency = {t: sum(any(t in c for c in cs) for cs in tokens.values()) for t in terms}
        n = max(len(documents), 1)
        idf = {t: math.log((n + 1) / (f + 1)) + 1 if f else 0.1 for t, f in frequency.items()}
        best = {}
        for d, cs in tokens.items():
            for i, c in enumerate(cs):
                if terms & c:
                    score = round(sum(idf[t] for t in terms & c) / len(terms), 10)
                    if d not in best or score > best[d][0]:
                        best[d] = (score, i)
        ranked = sorted(((-s, d, i) for d, (s, i) in best.items()))[:k]
        hits = [(d, i, round(-s, 6)) for s, d, i in ranked]
        others = [d for d in sorted(chunked) if chunked[d] and d not in best]
        hits += [(d, 0, 0.0) for d in others[: k - len(hits)]]
        results[q] = hits
    return results


@pytest.mark.parametrize("seed", [1, 2])
def test_search_like_the_plain_loop(frame, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "data", "quality", "Test", "null", "zeta", "é", "spark,"] + [f"w{i}" for i in range(40)]
    weights = [30, 20] + [1] * (len(vocabulary) - 2)
    documents = {i: " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 3, 150, 400]))) for i in range(30)}
    queries = {1: "The quality of", 2: "Qualidade? dados!", 3: "nothing here", 4: "w1 W2 w3 the the", 5: " ", 6: "nulos testes"}
    docs = frame(list(documents.items()), "doc_id int, text string")
    asked = frame(list(queries.items()), "query_id int, query string")
    found = {}
    for r in S.search(docs, asked, k=6).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["chunk_no"], round(r["score"], 6)))
    assert found == brute_force(documents, queries, 6)


def test_citations_and_relevance(frame):
    hits = frame(
        [(1, 1, 7, "Check the null values. Fix them. Then report. Done now. " * 3), (1, 2, 8, "short"), (1, 3, 9, "completely unrelated passage with more than fifty characters in it")],
        "query_id int, rank int, doc_id int, text string",
    )
    cited = S.citations(hits).orderBy("citation_id").collect()
    assert cited[0]["text"].endswith("...") and len(cited[0]["text"]) <= 203 and cited[1]["text"] == "short..."
    asked = frame([(1, "null issues and validation")], "query_id int, query string")
    rows = S.snippet_relevance(hits, asked).collect()
    assert len(rows) == 1
    assert rows[0]["relevance"] == 2 + 2 + 3 + 1
    assert rows[0]["snippet"] == "Check the null values. Fix them. Then report."


def test_intent(frame):
    texts = ["LIST all please", "what files?", "show the sources", "quais base", "the data quality", "which one", "Show me files", "minha lista"]
    df = frame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.asks_for_sources(F.col("t"))).collect()] == [True, True, True, True, False, False, True, True]


def test_collection_upkeep(frame):
    indexed = frame([(1, "a.md", "x")], "doc_id int, filename string, text string")
    incoming = frame([(2, "a.md", "new"), (3, "b.md", "  "), (4, "c.md", "ok")], "doc_id int, filename string, text string")
    both = D.import_new(indexed, incoming)
    assert sorted(r["doc_id"] for r in both.collect()) == [1, 4]
    assert [r["doc_id"] for r in D.delete_documents(both, frame([(1,), (99,)], "doc_id int")).collect()] == [4]
    stats = D.corpus_stats(both, chunk_documents(both)).first()
    assert (stats["documents"], stats["chunks"], stats["characters"]) == (2, 2, 3)


def test_shallow_and_titles(frame):
    df = frame([("tiny", "my_TEST.txt"), ("tiny", "a.md"), ("x" * 100, "a.md"), (" # Big  title\nrest", "r.md"), ("#no", "r.txt")], "text string, filename string")
    assert [r["reason"] for r in D.shallow_documents(df).collect()] == ["small_test_document", "small_content", None, "small_content", "small_content"]
    assert [r[0] for r in df.select(D.markdown_title(F.col("text"), F.col("filename"))).collect()] == [None, None, None, "Big  title", None]


def test_vectors_like_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(6)
    queries = df.filter("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = np.float32(data).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expected = {}
    for q in range(7):
        score = np.round(unit @ unit[q], 6)
        expected[q] = [int(i) for i in np.lexsort((np.arange(200), -score))[:5]]
    read = lambda: {q: [r["vec_id"] for r in rows] for q, rows in _grouped(vector_topk(df, queries, 5)).items()}
    assert read() == expected
    monkeypatch.setattr("tidemark.operators.vectors.QUERY_ROWS", 3)
    monkeypatch.setattr("tidemark.operators.vectors.STORED_ROWS", 11)
    assert read() == expected
    monkeypatch.setattr("tidemark.operators.vectors.CELL_ROWS", 9)
    assert read() == expected
    wrong = df.unionByName(spark.createDataFrame([(900, [1.0, 2.0]), (901, None)], "vec_id long, embedding array<float>"))
    with pytest.raises(Exception, match="components"):
        vector_topk(wrong, queries, 5).collect()
    missing = df.unionByName(spark.createDataFrame([(901, None)], "vec_id long, embedding array<float>"))
    assert vector_topk(missing, queries, 5).count() == 35
    assert vector_topk(df, queries.limit(0), 5).collect() == []


def test_clustered_vectors_meet_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    data = np.concatenate([centres.repeat(40, 0) + rng.normal(size=(480, 16)) * 0.05, np.zeros((3, 16)), np.tile(centres[0], (200, 1))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr("tidemark.operators.vectors.CELL_ROWS", 20)
    monkeypatch.setattr("tidemark.operators.vectors.STORED_ROWS", 32)
    index = VectorIndex(df)
    # the copies of one vector are one cell, in parts
    assert len(index.cells) > 12 and index.parts.max() > 5 and -1 in index.cells
    asked = df.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = []
    reached = VectorIndex._reached
    monkeypatch.setattr(VectorIndex, "_reached", lambda self, *a, **o: pairs.append(reached(self, *a, **o)) or pairs[-1])
    found = {q: [(r["id"], r["similarity"]) for r in rows] for q, rows in _grouped(index.search(asked, 6)).items()}
    norms = np.linalg.norm(data, axis=1, keepdims=True)
    unit = np.divide(data, norms, out=np.zeros_like(data), where=norms > 0)
    for q in range(0, len(data), 7):
        score = np.round(unit @ unit[q], 6)
        order = np.lexsort((np.arange(len(data)), -score))[:6]
        assert [i for i, _ in found[q]] == order.tolist()
    # of all pairs of a query and a part of a cell; the zero query meets all
    met = sum(p.where("query_id != 483").count() for p in pairs)
    assert met < 0.35 * asked.count() * index.parts.sum()


def _nearest_by_loop(ids, data, asked, k):
    """The k nearest of each asked id, all rows that share an id together."""
    norms = np.linalg.norm(data, axis=1, keepdims=True)
    unit = np.divide(data, norms, out=np.zeros_like(data), where=norms > 0)
    out = {}
    for q in asked:
        score = np.round(unit[ids == q] @ unit.T, 6).ravel()
        found = np.tile(ids, int((ids == q).sum()))
        out[q] = [(int(found[i]), float(score[i])) for i in np.lexsort((found, -score))[:k]]
    return out


def _small_blocks(monkeypatch):
    for name, rows in {"CELL_ROWS": 20, "STORED_ROWS": 32, "QUERY_ROWS": 16}.items():
        monkeypatch.setattr(f"tidemark.operators.vectors.{name}", rows)


def test_vectors_without_clusters_are_shuffled_a_fixed_number_of_times(spark, monkeypatch):
    rng = np.random.default_rng(3)
    # the copies are a cell of many parts; some ids come twice, with other vectors
    data = np.concatenate([rng.normal(size=(400, 16)), np.tile(rng.normal(size=16), (300, 1)), np.zeros((2, 16))])
    ids = np.arange(len(data))
    ids[5:9] = ids[50:54]
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, data)], "vec_id long, embedding array<double>").repartition(5)
    _small_blocks(monkeypatch)
    shipped = []
    reached = VectorIndex._reached
    monkeypatch.setattr(VectorIndex, "_reached", lambda self, *a, **o: shipped.append(reached(self, *a, **o)) or shipped[-1])
    index = VectorIndex(df)
    assert len(index.cells) > 8 and index.parts.max() > 5
    found = index.search(df.select(F.col("vec_id").alias("query_id"), "embedding"), 6)
    assert {q: [(r["id"], r["similarity"]) for r in rows] for q, rows in _grouped(found).items()} == _nearest_by_loop(ids, data, sorted(set(ids.tolist())), 6)
    # before, each vector was sent to all parts of all cells
    assert sum(s.count() for s in shipped) < 2 * len(data)
    # no block of queries, and no task, gets most of them
    assert max(r["count"] for r in shipped[0].where("home").groupBy("cell", "deal").count().collect()) < 60


def test_blocks_of_clustered_queries_meet_few_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(12, 16)).repeat(60, 0) + rng.normal(size=(720, 16)) * 0.05
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(5)
    _small_blocks(monkeypatch)
    pairs = []
    met = VectorIndex._met
    monkeypatch.setattr(VectorIndex, "_met", lambda self, asked: pairs.append((met(self, asked), asked.count() * self.blocks.count())) or pairs[-1][0])
    found = VectorIndex(df).search(df.select(F.col("vec_id").alias("query_id"), "embedding"), 6)
    assert {q: [(r["id"], r["similarity"]) for r in rows] for q, rows in _grouped(found).items()} == _nearest_by_loop(np.arange(720), data, range(720), 6)
    # the first parts, then the cells that can hold a better vector
    shares = [p.count() / full for p, full in pairs]
    assert len(shares) == 2 and max(shares) < 0.25, shares
    # vectors are read where they lie
    plan = pairs[1][0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def _grouped(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r)
    return out
