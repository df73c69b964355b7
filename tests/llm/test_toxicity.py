import random

import numpy as np

from tidemark.llm.toxicity import Model, bounded_labels, fit, toxicity, train

from .documents import WORDS, edge_docs, prose


def test_pairs_that_no_single_term_tells(spark):
    """Only both terms together are toxic; each alone is as common among clean texts."""
    rng = np.random.default_rng(1)
    present = rng.integers(0, 2, (4000, 6)).astype(np.float32)
    label = (present[:, 0] * present[:, 1]).astype(float)
    bias, weight, v = fit(present, label, rounds=800)
    model = Model(np.arange(6), bias, weight, v)
    raw = lambda at: 1 / (1 + np.exp(-(bias + weight[at].sum() + 0.5 * (v[at].sum(0) ** 2 - (v[at] ** 2).sum(0)).sum())))
    assert raw([0, 1]) > 0.8 and raw([0]) < 0.2 and raw([1]) < 0.2 and raw([2, 3]) < 0.1
    assert model.bias == bias


def labelled(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = prose(rng, 40).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(["blorp", "zonkface", "zonkhead"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_learns_words_and_beginnings(spark):
    model = train(spark.createDataFrame(labelled(1, 800), "doc_id long, text string, label int"))
    test = labelled(2, 200) + [(1000, "You ZONKNOSE!", 1)]
    scores = {r.doc_id: r.score for r in toxicity(spark.createDataFrame([t[:2] for t in test], "doc_id long, text string"), model).collect()}
    assert all((scores[i] >= 0.3) == bool(y) for i, _, y in test)


def paired(seed, n):
    """Each of four words is as common in toxic as in clean texts; which two stand together tells."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = i % 2, i // 2 % 2
        words = prose(rng, 12).split() + [("blorp", "zonk")[a], ("quix", "fnord")[b]]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    return rows


def test_learns_pairs_of_terms_that_tell_nothing_alone(spark):
    model = train(spark.createDataFrame(paired(1, 1200), "doc_id long, text string, label int"))
    test = paired(2, 200)
    scores = {r.doc_id: r.score for r in toxicity(spark.createDataFrame([t[:2] for t in test], "doc_id long, text string"), model).collect()}
    assert all((scores[i] > 0.5) == bool(y) for i, _, y in test)


def test_terms_are_not_limited_in_number(spark):
    rows = [(i, f"{''.join(chr(97 + int(d)) for d in str(i % 1000).zfill(3))}q", i % 2) for i in range(4000)]
    assert len(train(spark.createDataFrame(rows, "doc_id long, text string, label int")).place) >= 1000


def test_awkward_rows(spark):
    model = train(spark.createDataFrame(labelled(1, 400) + [(None, None, 1), (7, "", None)], "doc_id long, text string, label int"))
    docs = edge_docs(spark)
    rows = toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity(edge_docs(spark, []), model).collect() == []


def test_nothing_to_learn_from(spark):
    model = train(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert {r.score for r in toxicity(edge_docs(spark), model).collect()} == {0.5}


def test_bounded_sample(spark):
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    first = bounded_labels(labels, "toxic", 20).collect()
    assert len(first) == 20 and first == bounded_labels(labels.repartition(5), "toxic", 20).collect()
    assert WORDS
