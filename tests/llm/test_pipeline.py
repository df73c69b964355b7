import corpus_pipeline

from .documents import edge_docs, edge_rows


def test_stages_keep_columns_and_clean_documents(spark):
    rows = edge_rows() + [(700, "12 34"), (701, "a clean text that nothing is like, in plain words")]
    docs = edge_docs(spark, rows)
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
        ids[name] = {r.doc_id for r in docs.collect()}
    assert not ids["language_id"] & {100, 101, 102, 700} and {103, 701} <= ids["language_id"]
    assert 106 in ids["exact_dedup"] and not ids["exact_dedup"] & {1, 105}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.collect()} == ids["mix_sources"]


def test_empty_documents(spark):
    docs = edge_docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.collect() == []
        docs = docs if "piece" in out.columns else spark.createDataFrame([], docs.schema)


def test_run_over_the_tables(spark):
    import os

    import pytest

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.length <= 2048 for r in rows)
