import numpy as np
import pytest

from tidemark.llm.language import Model, keep_known, languages, train, viterbi

from .documents import edge_docs, edge_rows

TEXTS = {
    "en": "the weather is fine today and we are going to the market with all of our friends",
    "de": "das Wetter ist heute schön und wir gehen mit allen unseren Freunden auf den Markt",
    "fr": "il fait beau aujourd'hui et nous allons au marché avec tous nos amis de la ville",
    "ru": "сегодня хорошая погода и мы идём на рынок со всеми нашими друзьями из города",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, l) for i, (l, t) in enumerate(TEXTS.items())] + [(9, "no label", None), (None, None, "en")]
    return train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def best_paths(scores, penalty):
    """All assignments of a short text, scored one by one."""
    from itertools import product

    value = lambda p: sum(scores[t, k] for t, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    paths = {p: value(p) for p in product(range(scores.shape[1]), repeat=len(scores))}
    return paths, max(paths.values())


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    size = np.array([5, 0, 7, 1, 3])
    scores = rng.normal(size=(size.sum(), 3)).astype(np.float32) * 3
    found, at = viterbi(scores, size, 2.0), 0
    for n in size:
        paths, best = best_paths(scores[at : at + n], 2.0)
        assert paths[tuple(found[at : at + n].tolist())] == pytest.approx(best, abs=1e-4)
        at += n


def test_spans_of_mixed_text(spark, model):
    mixed = TEXTS["en"] + " . " + TEXTS["de"]
    row = languages(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, with_spans=True).first()
    assert [s.split(":")[0] for s in row.spans] == ["en", "de"] and 0.4 < row.score < 0.6


def test_scripts_narrow_candidates(model):
    assert [model.langs[k] for k in model.scores(["новое", "word"]).argmax(1)][0] == "ru"
    assert not model.allowed[:, model.langs.index("ru")].all()


def test_awkward_rows(spark, model):
    docs = edge_docs(spark, edge_rows() + [(800, "12 34 !!"), (801, TEXTS["fr"]), (802, "汉字")])
    rows = languages(docs, model).collect()
    assert len(rows) == docs.count()
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert found[100] == found[101] == found[102] == found[800] == ("und", 0.0)
    assert found[801] == ("fr", 1.0) and found[802][0] in TEXTS
    kept = keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.lang_pred != "und"}


def test_nothing_learned_and_empty(spark, model):
    nothing = train(edge_docs(spark, []))
    assert isinstance(nothing, Model) and {r.lang_pred for r in languages(edge_docs(spark), nothing).collect()} == {"und"}
    assert languages(edge_docs(spark, []), model).collect() == []


def test_keep_without_a_learned_language(spark):
    rows = [(1, "a clean text"), (2, "12 34"), (3, None), (4, ""), (5, "чистый текст"), (6, "_ 7 é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nothing = train(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.doc_id for r in keep_known(docs, nothing).collect()} == {1, 5, 6}


def test_three_hundred_languages(spark):
    word = lambda k: "".join(chr(97 + (k * 7 + i * (k % 11 + 3)) % 26) for i in range(6)) + "abcdefghijklmnopqrstuvwxyz"[k % 26] * 2 + str("xyz"[k % 3]) + "qwertyuiop"[k // 30]
    rows = [(k, " ".join([word(k)] * 12), f"l{k:03d}") for k in range(300)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = languages(spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), model).collect()
    assert len(model.langs) == 300 and sum(r.lang_pred == f"l{r.doc_id:03d}" for r in found) > 290
    # back pointers to languages beyond what one byte numbers
    scores = np.full((6, 300), -10.0, np.float32)
    scores[:3, 299], scores[3:, 131] = 0, 0
    assert viterbi(scores, np.array([6]), 5.0).tolist() == [299] * 3 + [131] * 3
