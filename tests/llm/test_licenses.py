import random

import duckdb
import pytest

from tests.compare import same
from tidemark.llm import queries
from tidemark.llm.licenses import NOTICES, PHRASES, license_notices

from .documents import WORDS, edge_docs, edge_rows, prose


def found(spark, rows, **options):
    return {r.doc_id: r for r in license_notices(edge_docs(spark, rows), **options).collect()}


def marred(rng, text, share):
    """The notice with some words replaced, dropped or doubled."""
    out = []
    for word in text.split():
        if rng.random() > share:
            out.append(word)
            continue
        out += rng.choice([[rng.choice(WORDS)], [], [word, word]])
    return " ".join(out)


def test_query_equals_its_sql_on_marred_notices(spark, tmp_path):
    rng = random.Random(5)
    rows = edge_rows() + [(103, "cc by nc"), (None, "under the MIT license")]
    for i in range(300):
        parts = [prose(rng, rng.randrange(1, 40)) for _ in range(3)]
        parts += [marred(rng, rng.choice(NOTICES + PHRASES)[1], rng.choice([0, 0.03, 0.1, 0.3])) for _ in range(rng.randrange(0, 5))]
        rng.shuffle(parts)
        rows.append((5000 + i, rng.choice([" ", ". ", "\n// ", "  "]).join(parts).upper() if i % 3 else " ".join(parts)))
    rows += [(6000, "cc by nc " * 5000), (6001, (NOTICES[0][1] + " ") * 40), (6002, "of the license " * 3000)]
    edge_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same(queries.op11_licenses(spark, str(tmp_path)), duck.execute(queries.OP11)) == len(rows)


def test_notices_are_told_apart_and_survive_edits(spark):
    gpl = next(t for label, t in NOTICES if label == "gpl-3")
    lgpl = next(t for label, t in NOTICES if label == "lgpl-3")
    mit = next(t for label, t in NOTICES if label == "mit")
    cut = mit.replace("free of charge, to any person", "free of any charge, to every person").replace("publish, distribute, ", "")
    got = found(spark, [(1, "alpha " + gpl + " beta"), (2, lgpl), (3, "beta " * 500 + cut + " gamma" * 500), (4, "the terms of the license are permitted"), (5, gpl + " " + cut)])
    labels = {i: [(s.label, s.start) for s in r.spans] for i, r in got.items()}
    assert labels == {1: [("gpl-3", 1)], 2: [("lgpl-3", 0)], 3: [("mit", 500)], 4: [], 5: [("gpl-3", 0), ("mit", len(gpl.replace("/", " ").split()))]}
    assert got[1].score == got[2].score == 1.0 and 0.75 < got[3].score < 1.0 and got[4].score < 0.5 and not got[3].places


def test_places_of_phrases_overlap_and_stay_in_order(spark):
    got = found(spark, [(1, "x cc-by-nc, cc by nc! under the MIT Licence"), (2, "under the mit license version 2 Apache license version 2"), (3, None), (4, "cc by"), (5, "ÄCC BY NC é")])
    assert [(p.label, p.start, p.end) for p in got[1].places] == [("cc-by-nc", 1, 4), ("cc-by-nc", 4, 7)]
    assert [(p.label, p.start) for p in got[2].places] == [("mit", 0), ("apache-2", 6)]
    # letters beyond ASCII belong to words and keep their case
    assert not got[3].places and got[3].n_words == 0 and not got[4].places and not got[5].places


def test_many_templates_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(i, f"alpha {t} omega") for i, (_, t) in enumerate(PHRASES + NOTICES)] + [(90, None)]
    few = {i: r.asDict() for i, r in found(spark, rows).items()}
    monkeypatch.setattr("tidemark.llm.licenses.BROADCAST_CHARACTERS", 10)
    assert {i: r.asDict() for i, r in found(spark, rows).items()} == few


def test_empty_table_and_short_templates(spark):
    assert license_notices(edge_docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        license_notices(edge_docs(spark, []), phrases=[("x", "two words")])
