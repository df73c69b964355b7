import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidemark.llm.simhash import BROADCAST_GONE, fingerprint, simhash_groups, simhash_keep, trie_links

from .documents import by_key, edge_docs, edge_rows


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in words.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, distance):
    """Smallest index reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


def test_fingerprints_equal_the_plain_form():
    for _, text in edge_rows():
        assert fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_groups_with_awkward_rows(spark):
    rows = edge_rows()
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = linked(fps, 2)
    least = {}
    for (doc_id, _), r in zip(rows, roots):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    want = [(d, f - (1 << 64) if f >> 63 else f, least.get(r)) for (d, _), f, r in zip(rows, fps, roots)]
    assert by_key(simhash_groups(edge_docs(spark)).collect()) == by_key(want)


@pytest.mark.parametrize("broadcast_gone", [BROADCAST_GONE, 0])
def test_keep_leaves_columns_and_one_of_each_group(spark, broadcast_gone):
    docs = edge_docs(spark)
    kept = simhash_keep(docs, broadcast_gone=broadcast_gone)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 105 not in ids and 106 not in ids and 1 in ids and ids.count(None) == 2


def test_another_text_under_a_used_id_stays(spark):
    near, clean = "one text that is here twice under two ids", "something else entirely, which nothing in this table is like"
    docs = spark.createDataFrame([(1, near), (2, near), (2, clean), (3, "a third text with words of its own in it")], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash_keep(docs).collect()]
    assert len(kept) == 3 and (2, clean) in kept and (2, near) not in kept


def test_empty_table(spark):
    assert simhash_groups(edge_docs(spark, [])).collect() == []


def test_trie_finds_all_pairs_when_nodes_are_opened(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for _ in range(250)}
    fps |= {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    for node_rows in (4, 256):
        links = trie_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, node_rows).collect()
        place = {f: k for k, f in enumerate(signed)}
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            assert (fps[place[a]] ^ fps[place[b]]).bit_count() <= 2
            x, y = find(place[a]), find(place[b])
            root[max(x, y)] = min(x, y)
        assert [find(x) for x in range(len(fps))] == linked(fps, 2)
