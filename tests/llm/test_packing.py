import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import Ids, _sum_of_squares, packed_documents

from .documents import by_key, edge_docs, edge_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer):
    encode = Ids(PATH)
    for text in ["", "wordЖ Жword x1y don't we'll  ", "a\xa0b\x85c\u3000d\u200be", " ,a  ,b\n\n c\t d", " ", "  ", "a  b \n c", " x", "x ", "it's  'll\n\n\nfoo", "\x1c a　b  c", "<|endoftext|> z", *[t or "" for _, t in edge_rows()]]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]


@pytest.mark.parametrize("items_per_task", [100_000, 8])
def test_every_id_has_one_place(spark, tokenizer, items_per_task):
    rows = edge_rows()
    got = packed_documents(edge_docs(spark), PATH, length=256, items_per_task=items_per_task, with_ids=True).collect()
    ids = defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert len(part) == r.length <= 256 and zlib.crc32(r.ids) == r.ids_crc32 and (r.length == 256 or r.piece == 0)
        if r.doc_id not in (None, 2):
            assert r.start == len(ids[r.doc_id])
        ids[r.doc_id] += part
    for doc_id, text in rows:
        if doc_id not in (None, 2):
            assert ids[doc_id] == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    whole = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in got) == whole
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(filled) <= whole / 256 + (2 if items_per_task > 8 else 6)


def test_runs_agree(spark):
    docs = edge_docs(spark)
    first, second = packed_documents(docs, PATH), packed_documents(docs.repartition(5), PATH)
    columns = ["doc_id", "piece", "length", "sequence_id", "offset"]
    assert by_key(first.where("length < 2048").select(columns).collect()) == by_key(second.where("length < 2048").select(columns).collect())


def test_empty_table(spark):
    assert packed_documents(edge_docs(spark, []), PATH).collect() == []


def test_sum_of_squares_against_the_plain_rule():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 40, 120))[::-1]
    bins, offsets, gaps = _sum_of_squares(sizes, 40)
    used = defaultdict(int)
    for size, place, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        open_gaps = [40 - u for u in used.values() if u < 40]
        if place not in used:
            assert all(g < size for g in open_gaps)
        else:
            def squares(gap):
                after = sorted(open_gaps)
                after.remove(gap)
                after += [gap - size] * (gap > size)
                return sum(after.count(g) ** 2 for g in set(after))

            assert squares(40 - used[place]) == min(squares(g) for g in set(open_gaps) if g >= size)
        assert offset == used[place]
        used[place] += size
    assert [40 - used[k] for k in range(len(gaps))] == gaps.tolist()


def test_added_tokens_are_cut_out_first():
    tokenizer, encode = Tokenizer.from_file(PATH), Ids(PATH)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    rng = random.Random(8)
    parts = [*added, " ", "\n\n", "word", " the", "é", "<|", "\x1c", "12", "\t"]
    texts = ["The end.\n\n<|endoftext|>Next"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
