import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact import BROADCAST_HITS, digest_state, exact_groups, exact_keep, sha256
from tidemark.session import scratch_path

from .documents import by_key, edge_docs, edge_rows


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out = []
    for doc_id, text in rows:
        t = lowered(text)
        out.append((doc_id, keep[t], len(groups[t]), doc_id == keep[t], hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("broadcast_hits", [BROADCAST_HITS, 0])
@pytest.mark.parametrize("digest", [sha256, lambda text: F.length(text).cast("string")])
def test_groups_even_if_texts_share_a_digest(spark, digest, broadcast_hits):
    rows = edge_rows() + [(900, "abc"), (901, "xyz"), (902, "ABC"), (903, "uvw")] + [(1000 + i, "a copy of many") for i in range(200)]
    got = exact_groups(edge_docs(spark, rows), digest, broadcast_hits=broadcast_hits).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_sha256"))).collect()
    assert by_key(got) == by_key(plain(rows))


@pytest.mark.parametrize("broadcast_gone", [BROADCAST_HITS, 0])
def test_keep(spark, broadcast_gone):
    docs = edge_docs(spark)
    kept = exact_keep(docs, broadcast_gone)
    assert kept.columns == docs.columns
    want = [(i, t) for (i, t), p in zip(edge_rows(), plain(edge_rows())) if p[3]]
    assert by_key((r.doc_id, r.text) for r in kept.collect()) == by_key(want)


def test_empty_table(spark):
    assert exact_groups(edge_docs(spark, [])).collect() == []


def test_state_goes_on_where_the_last_run_ended(spark):
    folder, source = scratch_path(spark, "state"), scratch_path(spark, "arriving")
    schema = "digest binary, doc_id long, locator string"
    for rows in ([(b"a", 1, "f"), (b"b", 2, "f")], [(b"a", 5, "g")], [(b"c", 3, "h"), (b"a", 4, "h")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        state = digest_state(spark, spark.readStream.schema(schema).parquet(source), folder)
    got = sorted((bytes(r.digest), r.n, r["last"].doc_id, r["last"].locator) for r in state.collect())
    assert got == [(b"a", 3, 5, "g"), (b"b", 1, 2, "f"), (b"c", 1, 3, "h")]
