"""The stored index: searches against the plain loop, upkeep against a fresh build."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import index as module
from tidemark.operators import search as S
from tidemark.operators.index import SearchIndex, _Best
from tidemark.session import scratch_path

from .test_text import brute_force

VOCABULARY = ["the", "of", "data", "quality", "Test", "null", "zeta", "é", "spark,"] + [f"w{i}" for i in range(60)]
WEIGHTS = [40, 30] + [2] * (len(VOCABULARY) - 2)
QUERIES = {1: "The quality of", 2: "Qualidade? dados!", 3: "nothing here", 4: "w1 W2 w3 the the", 5: " ", 6: "nulos testes", 7: "w9 w10 w11 w12 w13 of"}


def texts(rng, ids, lengths=(0, 3, 150, 400, 9000)):
    return {i: " ".join(rng.choices(VOCABULARY, WEIGHTS, k=rng.choices(lengths, [2, 6, 6, 3, 1])[0])) for i in ids}


def frame_of(spark, documents):
    return spark.createDataFrame(list(documents.items()), "doc_id long, text string")


def found(spark, index, k):
    asked = spark.createDataFrame(list(QUERIES.items()), "query_id int, query string")
    out = {}
    for r in S.Search(index, asked, k).hits().orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["chunk_no"], round(r["score"], 6)))
        words = documents_words(index, r["id"])
        assert r["text"] == " ".join(words[r["chunk_no"] * 116 : r["chunk_no"] * 116 + 128])
    return out


KNOWN = {}


def documents_words(index, doc_id):
    return KNOWN[doc_id].split()


@pytest.fixture
def empty(spark):
    return SearchIndex.create(spark, scratch_path(spark, "index"))


def test_upkeep_equals_a_fresh_build(spark, empty):
    rng = random.Random(3)
    first, second, third = texts(rng, range(40)), texts(rng, range(40, 70)), texts(rng, range(70, 75))
    KNOWN.clear()
    KNOWN.update(first | second | third)
    # ids the index holds are not imported again, whatever their text
    index = empty.add(frame_of(spark, first), buckets=3).add(frame_of(spark, second | {3: "zeta " * 50}), buckets=2)
    both = first | second
    assert found(spark, index, 6) == brute_force(both, QUERIES, 6)
    gone = [0, 5, 39, 41, 60, 60, 999]
    index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    # one that was deleted can come back, in another segment
    index = index.add(frame_of(spark, third | {5: "w1 w2 quality"}))
    KNOWN[5] = "w1 w2 quality"
    left = {i: t for i, t in both.items() if i not in gone} | third | {5: KNOWN[5]}
    assert found(spark, index, 6) == brute_force(left, QUERIES, 6)
    assert len(index.segments) == 3 and index.total_documents() == len(left)
    index = index.delete(spark.createDataFrame([(70,), (5,)], "doc_id long"))
    left = {i: t for i, t in left.items() if i not in (70, 5)}
    partly = index.merge(most_segments=2)
    assert len(partly.segments) == 2 and partly.total_documents() == len(left)
    with pytest.raises(Exception, match="already exists"):
        # a change made from an old version
        index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert found(spark, partly.merge(buckets=2), 6) == brute_force(left, QUERIES, 6)
    # the state is in the files
    merged = SearchIndex(spark, index.path)
    assert len(merged.segments) == 1 and not merged.marks and merged.total_documents() == len(left)


def test_upkeep_reads_no_old_texts(spark, empty, monkeypatch):
    rng = random.Random(4)
    index = empty.add(frame_of(spark, texts(rng, range(20)))).add(frame_of(spark, texts(rng, range(20, 30))))
    read = []
    stored = SearchIndex._table
    monkeypatch.setattr(SearchIndex, "_table", lambda self, name, marks=False: read.append(name) or stored(self, name, marks))
    new = SearchIndex._new
    monkeypatch.setattr(SearchIndex, "_new", lambda self, name, segment: read.append(f"{name} new") or new(self, name, segment))
    index.delete(spark.createDataFrame([(1,), (25,)], "doc_id long")).merge()
    assert "texts" not in read and "texts new" not in read and "postings" in read
    read.clear()
    SearchIndex(spark, index.path).add(frame_of(spark, texts(rng, range(30, 35))))
    assert "postings" not in read and "texts" not in read and "texts new" in read


def test_blocks_below_the_kth_score_are_not_scored(monkeypatch):
    # word 0 stands everywhere, word 1 in the first and in the last block only
    best = _Best(2, 2, np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([0.1, 0.2, 0.9]))
    scored = []
    keep = _Best._keep
    monkeypatch.setattr(_Best, "_keep", lambda self, *columns: scored.append(sorted(set(columns[0].tolist()))) or keep(self, *columns))
    every = (1 << 40) - 1
    ids = list(range(40))
    best.see(1, 0, ids, [0] * 40, np.array([0, 1]), np.array([every, 0b110]))
    assert best.least.tolist() == [1.0, 0.2] and best.id.tolist() == [1, 2, 0, 1]
    for block in range(1, 5):
        best.see(1, 0, [i + 100 * block for i in ids], [0] * 40, np.array([0]), np.array([every]))
    # equal scores are looked at, lower ones not
    assert scored[1:] == [[0, 1]] * 4 and best.id.tolist() == [1, 2, 0, 1]
    best.see(1, 1, [-5, -4], [0, 3], np.array([0, 1]), np.array([0b11, 0b10]))
    assert best.id.tolist() == [-4, 1, -5, -4] and best.number.tolist() == [3, 0, 0, 3]


def test_queries_take_as_many_passes_as_they_need(spark, empty, monkeypatch):
    rng = random.Random(6)
    documents = texts(rng, range(30), (3, 150, 400, 500, 9000))
    KNOWN.update(documents)
    index = empty.add(frame_of(spark, documents), buckets=2)
    monkeypatch.setattr("tidemark.operators.index.PASS_WORDS", 6)
    assert found(spark, index, 4) == brute_force(documents, QUERIES, 4)


def test_empty_index_and_awkward_rows(spark, empty):
    asked = spark.createDataFrame([(1, "the data"), (2, None)], "query_id int, query string")
    assert S.Search(empty, asked).hits().collect() == []
    nothing = empty.add(spark.createDataFrame([], "doc_id long, text string"))
    assert S.Search(nothing, asked).hits().collect() == []
    odd = nothing.add(spark.createDataFrame([(1, None), (2, " \t"), (None, "the data"), (3, "DATA the"), (4, "other")], "doc_id long, text string"))
    rows = S.Search(odd, asked).hits().orderBy("rank").collect()
    assert [(r["query_id"], r["id"], r["score"] > 0) for r in rows] == [(1, 3, True), (1, 4, False)] and odd.total_documents() == 4
    gone = odd.delete(spark.createDataFrame([(1,), (3,)], "doc_id long"))
    assert gone.total_documents() == 2 and [r["id"] for r in S.Search(gone, asked).hits().collect()] == [4]
    assert {r["term"]: r["document_frequency"] for r in S.Search(gone, asked).idf().collect()} == {"the": 0, "data": 0}
    text = SearchIndex.create(spark, scratch_path(spark, "index"), "string").add(spark.createDataFrame([("b", "the"), ("a", "the")], "name string, body string"), "name", "body")
    assert [r["id"] for r in S.Search(text, asked).hits().orderBy("rank").collect()] == ["a", "b"]


def plain_scores(documents):
    """(query, id, chunk) and its score, pair by pair."""
    chunked = {d: [set(w[at : at + 128]) for at in range(0, len(w), 116)] for d, w in ((d, t.lower().split()) for d, t in documents.items())}
    every = {}
    for q, text in QUERIES.items():
        words = text.lower().split()
        terms = {t for w in words for t in (w, *S.TRANSLATIONS.get(w.strip(S.QUERY_PUNCTUATION), []))}
        frequency = {t: sum(any(t in c for c in chunks) for chunks in chunked.values()) for t in terms}
        weight = {t: (np.log((len(documents) + 1) / (f + 1)) + 1 if f else 0.1) / len(terms) for t, f in frequency.items()}
        for d, chunks in chunked.items():
            for n, c in enumerate(chunks):
                if terms & c:
                    every[q, d, n] = round(sum(weight[t] for t in terms & c), 6)
    return every


def test_scores_of_all_chunks_and_documents(spark, empty):
    """More documents than a search returns, some over several blocks, some deleted."""
    documents = texts(random.Random(8), range(60), lengths=(0, 3, 150, 700, 16000))
    index = empty.add(frame_of(spark, documents), buckets=3).delete(spark.createDataFrame([(4,), (17,)], "doc_id long"))
    asked = spark.createDataFrame(list(QUERIES.items()), "query_id int, query string")
    searching = S.Search(index, asked, k=2)
    expected = plain_scores({d: t for d, t in documents.items() if d not in (4, 17)})
    rows = searching.chunk_scores().collect()
    assert len(rows) == len(expected)
    assert {(r["query_id"], r["id"], r["chunk_no"]): round(r["score"], 6) for r in rows} == expected
    best = {}
    for (q, d, n), score in sorted(expected.items()):
        if score > best.get((q, d), (0, 0))[0]:
            best[q, d] = (score, n)
    rows = searching.best_chunks().collect()
    assert len(rows) == len(best)
    assert {(r["query_id"], r["id"]): (round(r["score"], 6), r["chunk_no"]) for r in rows} == best


def test_buckets_grow_with_the_text(spark, empty, monkeypatch):
    monkeypatch.setattr("tidemark.operators.index.BUCKET_BYTES", 2_000)
    index = empty.add(frame_of(spark, {i: "word " * 100 for i in range(60)}))
    assert index._table("documents").select("bucket").distinct().count() > 4
    other = index.add(frame_of(spark, {i: "word " * 100 for i in range(60, 70)})).merge()
    assert other._table("documents").select("bucket").distinct().count() > 4
    assert other.total_documents() == 70


def test_scores_of_a_repeated_id_add_up(spark, empty):
    index = empty.add(spark.createDataFrame([(1, "null data"), (1, "null data"), (2, "null")], "doc_id long, text string"), buckets=1)
    asked = spark.createDataFrame([(9, "null")], "query_id int, query string")
    rows = S.Search(index, asked).chunk_scores()
    assert rows.columns == ["query_id", "id", "chunk_no", "score"]
    assert sorted((r["id"], round(r["score"], 6)) for r in rows.collect()) == [(1, 2.0), (2, 1.0)]


def test_a_merge_moves_postings_in_cells(spark, empty, monkeypatch):
    """No row per word and chunk is shuffled: an old bucket sends a cell to each group of new ones."""
    monkeypatch.setattr(module, "MERGED_BUCKETS", 2)
    documents = texts(random.Random(11), range(60), lengths=(0, 3, 150, 700, 9000))
    KNOWN.update(documents)
    index = empty.add(frame_of(spark, dict(list(documents.items())[:30])), buckets=3).add(frame_of(spark, documents), buckets=2)
    stored, plans = SearchIndex._store_postings, []
    monkeypatch.setattr(SearchIndex, "_store_postings", lambda self, rows, segment: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or stored(self, rows, segment))
    merged = index.delete(spark.createDataFrame([(3,), (31,)], "doc_id long")).merge(buckets=5)
    assert len(plans) == 1 and "Generate explode(filter" not in plans[0] and "FlatMapCoGroupsInArrow" in plans[0]
    left = {i: t for i, t in documents.items() if i not in (3, 31)}
    assert found(spark, merged, 6) == brute_force(left, QUERIES, 6)
    fresh = SearchIndex.create(spark, scratch_path(spark, "index")).add(frame_of(spark, left), buckets=5)
    same = lambda i: sorted(map(tuple, i._table("postings").select("bucket", "block", "term", "bits").collect()))
    assert same(merged) == same(fresh)
    terms = lambda i: sorted(map(tuple, i._frequencies().collect()))
    assert terms(merged) == terms(fresh)


def test_postings_of_words_in_overlapping_chunks():
    rows = [pa.record_batch({"bucket": pa.array([4, 4, 4, 5], pa.int32()), "words": [["b", "a"] * 3, None, ["a"], ["c"]]})]
    made = [tuple(r.values()) for batch in module._said(4, 2)(iter(rows)) for r in batch.to_pylist()]
    # chunks 0 to 2 of the first text, the third one's is number 3
    assert made == [(4, 0, "a", 0b1111, 2), (4, 0, "b", 0b111, 1), (5, 0, "c", 1, 1)]
