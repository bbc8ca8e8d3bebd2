"""Decontamination against a brute-force search of every window."""

import re

import pytest

from peerlens.llm import decontaminate
from peerlens.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                names = windows.get(tuple(w[i:i + size]))
                if names:
                    hit |= set(range(i, i + size))
                    found |= names
        found.discard(None)
        out.append((doc, len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(map(str, r["items"])), r.contaminated) for r in rows), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_whole_tables(spark, data, block_bytes):
    docs, items = table(spark, data, "documents"), table(spark, data, "benchmark")
    found = decontaminate.contamination(docs, items, block_bytes)
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(found) == expected
    assert any(r[4] for r in expected)


def test_edges(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Only three words"), (3, ""), (None, "no name here"), (5, long), (2, "only THREE words"), (7, None)]
    docs = [
        (1, "x " + " ".join(long.split()[5:30]) + " y", "a"), (2, "only three words", "b"), (2, "only three words", "b"),
        (3, None, None), (4, "", "c"), (5, "no name here " + "z " * 100, "d"), (None, long, "e"),
        (6, " ".join(long.split()[:12]), "f"), (7, "Ünder only-three.words", "g"), (8, "a" * 5000, "h"),
        (9, ("q " * 5000) + long + (" r" * 5000), "i"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute([(d, t) for d, t, _ in docs], items)
    assert got(decontaminate.contamination(frame, bench)) == expected
    assert got(decontaminate.contamination(frame, bench, 100)) == expected
    match = {r.doc_id: r.matches for r in decontaminate.contamination(frame, bench).collect()}[1]
    assert [(m.item_id, m.start, m.item_start, m.words) for m in match] == [(1, 1, 5, 25), (5, 1, 5, 25)]
    left = decontaminate.drop_contaminated(frame, bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 8, 9]
    assert left.columns == frame.columns


def test_shards_overlap(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    text = " ".join(f"w{i % 7}" for i in range(400))
    tests = decontaminate.TestSet([(1, " ".join(f"w{i % 7}" for i in range(20)))])
    places, windows = tests.occurrences(tests.codes(decontaminate.word_hashes(text.encode())))
    assert len(places) == len(set(places.tolist())) == 400 - 12
    assert np.all(windows < 7)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    assert [tuple(r)[:4] for r in decontaminate.contamination(one, bench).collect()] == [(1, 2, 0, 0)]


def test_blocks_of_bytes(monkeypatch):
    monkeypatch.setattr(decontaminate, "_TEXT_BLOCK", 64)
    text = ("abc déf " * 50 + "x" * 300 + " end").encode()
    assert len(decontaminate.word_hashes(text)) == 102
    monkeypatch.setattr(decontaminate, "_TEXT_BLOCK", 1 << 20)
    assert len(decontaminate.word_hashes(text)) == 102


def test_drop_judges_rows_not_ids(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(None, passage), (None, "clean without id"), (None, None), (4, passage + " x"), (4, "clean under a repeated id"), (4, None), (5, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, "nothing of these words")], "item_id long, text string")
    for options in ({}, {"block_bytes": 50}):
        left = decontaminate.drop_contaminated(docs, bench, **options)
        assert left.columns == docs.columns
        kept = {(r.doc_id, r.text) for r in left.collect()}
        assert kept == {(None, "clean without id"), (None, None), (4, "clean under a repeated id"), (4, None)} and left.count() == 4


def test_copies_of_an_item_make_no_block_larger(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage)] * 50 + [(2, "two words"), (None, "no id")], "item_id long, text string")
    docs = spark.createDataFrame([(1, passage), (2, "clean"), (3, "two words")], "doc_id long, text string")
    made, init = [], decontaminate.TestSet.__init__
    monkeypatch.setattr(decontaminate.TestSet, "__init__", lambda self, items, *more: made.append(len(items)) or init(self, items, *more))
    rows = {r.doc_id: (r.items, r.contaminated) for r in decontaminate.contamination(docs, bench, 10 * len(passage)).collect()}
    assert rows == {1: ([1], True), 2: ([], False), 3: ([2], True)}
    assert made == [3]
