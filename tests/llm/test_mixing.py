import hashlib
from collections import defaultdict

import pytest

from tidemark.llm.mixing import mix_documents, mixture, schedule, taken_words, targets

from .documents import by_key, edge_docs


def plain_targets(size):
    """Shares by weight, with what is above three times the size shared again until nothing is."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, stopped, left = {}, set(), float(sum(size.values()))
    while True:
        free = sum(weight[s] for s in names if s not in stopped)
        for s in names:
            if s not in stopped:
                target[s] = left * weight[s] / free
        above = [s for s in names if s not in stopped and target[s] > 3 * size[s]]
        if not above:
            return target
        for s in above:
            target[s] = 3 * size[s]
            stopped.add(s)
            left -= target[s]


def plain_words(size, target, block):
    """Slots by the van der Corput points in each source's range; a slot is a block, a target below one block is its own."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    whole, ends, at = sum(target.values()), [], 0.0
    for s in names:
        at += target[s]
        ends.append(at / whole)
    ends[-1] = 1.0
    slots = defaultdict(int)
    for i in range(-(-sum(size.values()) // block)):
        x, step = 0.0, 0.5
        while i:
            x, i, step = x + step * (i & 1), i >> 1, step / 2
        slots[names[next(k for k, e in enumerate(ends) if x < e)]] += 1
    return {s: round(target[s]) if round(target[s]) < block else min(max(1, slots[s]) * block, 3 * size[s]) for s in names}


def test_targets_equal_the_plain_rule(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1, "b": 1, "c": 1000, "d": 3, "e": 2}, {"z": 9}, {"a": 0, "b": 5}):
        rows = targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = plain_targets(sizes)
        assert {r.source: r.target for r in rows} == pytest.approx(want)


def test_schedule_is_van_der_corput(spark):
    sizes = {"a": 500, "b": 300, "c": 200}
    source = targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
    from pyspark.sql import functions as F

    from tidemark.llm.mixing import DIGITS, _reversed

    source = source.withColumn("lo_turned", _reversed(F.col("lo"))).withColumn("hi_turned", _reversed(F.col("hi"))).withColumn("slots", F.lit(9)).withColumn("given", F.lit(9))
    ranges = {r.sid: (r.lo, r.hi) for r in source.collect()}
    seen = defaultdict(int)
    want = []
    for slot in range(300):
        point = int(f"{slot:0{DIGITS}b}"[::-1], 2)
        sid = next(s for s, (lo, hi) in ranges.items() if lo <= point < hi)
        want.append((slot, sid, seen[sid]))
        seen[sid] += 1
    assert sorted(map(tuple, schedule(source, 300).collect())) == want


def test_mix_of_awkward_rows(spark):
    docs = edge_docs(spark)
    rows = taken_words(docs, block_words=16).collect()
    assert len(rows) == docs.count()
    size = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
    target = plain_targets(size)
    words = plain_words(size, target, 16)
    assert any(words[s] != round(target[s]) for s in size)
    sums = defaultdict(int)
    for r in rows:
        sums[r.source] += r.taken
    assert {s: sums[s] for s in size} == words
    again = taken_words(docs.repartition(7), block_words=16).collect()
    assert by_key(again) == by_key(rows)


def test_taken_words_equal_the_plain_schedule(spark):
    rows = [(i, " ".join(["word"] * (3 + i * i % 50)), "abcd"[i * i % 7 % 4]) for i in range(300)] + [(900, "a few words", "e"), (901, None, "f")]
    size, own = defaultdict(int), defaultdict(list)
    for i, text, source in rows:
        size[source] += len((text or "").split())
        own[source].append((hashlib.md5(f"7:{i}".encode()).hexdigest(), i, len((text or "").split())))
    target = plain_targets(size)
    words, want = plain_words(size, target, 16), {}
    for source, listed in own.items():
        place = 0
        for _, i, n in sorted(listed):
            want[i] = sum(max(0, min(n, words[source] - place - c * size[source])) for c in range(3))
            place += n
    got = taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=16).collect()
    assert {r.doc_id: r.taken for r in got} == want
    for source in size:
        assert abs(words[source] - target[source]) <= 3 * 16


def test_first_slots_keep_the_weights_at_every_place(spark):
    texts = [(i, " ".join(["word"] * (5 + i % 40))) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in texts], "doc_id long, text string, source string")
    mix, _ = mixture(docs, block_words=16)
    slots = sorted({(p.slot, p.sid) for p in mix.collect()})
    for upto in (60, 200, len(slots)):
        for sid in range(3):
            assert abs(sum(s == sid for _, s in slots[:upto]) - upto * (sid + 1) / 6) <= 8
    for r in taken_words(docs, block_words=16).collect():
        assert (r.first_slot is None) == (r.taken == 0)
    first = {r.doc_id: r.first_slot for r in taken_words(docs, block_words=16).collect()}
    seen = defaultdict(list)
    for p in mix.collect():
        seen[p.sid, p.bucket, p.nth].append(p.slot)
    assert sorted(min(v) for v in seen.values()) == sorted(v for v in first.values() if v is not None)


def test_blocks_are_equal_and_cover_each_copy_once(spark):
    docs = edge_docs(spark)
    mix, rows = mixture(docs, block_words=16)
    pieces = mix.collect()
    blocks, seen = defaultdict(int), defaultdict(list)
    for p in pieces:
        blocks[p.sid, p.block] += p.words
        seen[p.sid, p.bucket, p.nth, p.copy].append((p.from_word, p.from_word + p.words))
    for sid in {s for s, _ in blocks}:
        own = [blocks[sid, k] for k in range(sum(s == sid for s, _ in blocks))]
        assert all(n == 16 for n in own[:-1]) and 0 < own[-1] <= 16
    for spans in seen.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len({p.slot for p in pieces}) == len(blocks)


def test_whole_copies(spark):
    docs = edge_docs(spark)
    mixed = mix_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    ids = [r.doc_id for r in mixed.collect()]
    assert ids.count(100) == ids.count(101) == ids.count(102) == 1


def test_copies_come_in_order_of_the_schedule(spark):
    docs = spark.createDataFrame([(i, " ".join(["word"] * (5 + i % 40)), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    mixed, slots = mix_documents(docs, block_words=16).collect(), defaultdict(dict)
    pieces, rows = mixture(docs, block_words=16)
    name = {(r.sid, r.bucket, r.nth): r.doc_id for r in rows.collect()}
    for p in pieces.collect():
        doc = slots[name[p.sid, p.bucket, p.nth]]
        doc[p.copy] = min(p.slot, doc.get(p.copy, p.slot))
    seen, order = defaultdict(int), []
    for r in mixed:
        order.append(slots[r.doc_id][seen[r.doc_id]])
        seen[r.doc_id] += 1
    assert order == sorted(order)
    for upto in (len(mixed) // 4, len(mixed) // 2):
        words = defaultdict(int)
        for r in mixed[:upto]:
            words[r.source] += len(r.text.split())
        whole = sum(words.values())
        assert all(abs(words[s] / whole - (k + 1) / 6) < 0.05 for k, s in enumerate("abc"))


def test_empty_tables(spark):
    assert taken_words(edge_docs(spark, [])).collect() == []
    assert [r.taken for r in taken_words(edge_docs(spark, [(1, None), (2, " ")])).collect()] == [0, 0]
