"""Exact duplicates against a plain grouping, with and without spills."""

import hashlib
import random
import re

import pytest

from peerlens.llm import exact_dedup
from peerlens.llm.common import table


def expected(rows):
    groups = {}
    for doc, text in rows:
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc is None, doc))
    out = []
    for body, members in groups.items():
        keep = min(members)[2]
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(doc, keep, len(members), sha) for _, _, doc in members]
    return sorted(out, key=repr)


def got(df):
    rows = df.collect()
    for r in rows:
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr)


@pytest.mark.parametrize("trie_bytes", [exact_dedup.TRIE_BYTES, 3000])
def test_whole_table(spark, data, trie_bytes):
    docs = table(spark, data, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(exact_dedup.exact_dedup(docs, trie_bytes)) == expected(rows)


def test_edges(spark):
    rows = [(1, "a b", "x"), (2, "a\tb ", "x"), (3, "ab", "x"), (4, None, "x"), (5, "", "x"), (6, " \n", "x"), (7, "A b", "x"), (8, "a b", "x"),
            (3, "ab", "x"), (None, "a  b  ", "x"), (9, "é" * 3000, "x"), (10, "é" * 3000 + " ", "x"), (11, "once", None), (11, "twice", None), (12, "twice", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    assert got(exact_dedup.exact_dedup(docs)) == expected([r[:2] for r in rows])
    left = exact_dedup.drop_exact(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted(
        [("None", "a  b  "), ("6", " \n"), ("7", "A b"), ("8", "a b"), ("10", "é" * 3000 + " "), ("11", "once"), ("11", "twice")])
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert exact_dedup.drop_exact(docs.filter("doc_id > 4 AND doc_id < 11")).count() == 4


def test_trie():
    rng = random.Random(1)
    trie, keys = exact_dedup.PatriciaTrie(), {bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(300)}
    for k in keys:
        trie.node(k).value = k
        trie.terminals += 1
    assert {path: node.value for path, node in trie.walk()} == {k: k for k in keys}
    assert trie.bytes < sum(map(len, keys))
    spilled = []
    while trie.terminals > 1:
        prefix, found = trie.spill()
        assert found and all(k.startswith(prefix) for k, _ in found)
        spilled += [k for k, _ in found]
        if trie.root.value is not None and not trie.root.edges:
            break
    rest = [k for k, _ in trie.walk()]
    assert sorted(spilled + rest) == sorted(keys) and not set(spilled) & set(rest)


def test_texts_of_one_key_are_told_apart(spark, monkeypatch):
    """Two different texts under the same length and hash are settled by the trie, over several rounds."""
    merge = exact_dedup._owner_tries(4)
    import pyarrow as pa

    names = ["doc_id", "row", "n_chars", "n_bytes", "hash", "token", "size", "body"]
    rows = [(i, i, 5, 5, 77, 100 + i, 1, body) for i, body in enumerate((b"aaaaa", b"abbbb", b"aaaaa", b"accccc"[:5], b"abbbb"))]
    settled, salt = {}, 0
    while rows:
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
        again = []
        for out in merge(iter([batch])):
            for r in out.to_pylist():
                if r["body"] is None:
                    settled[r["token"]] = (r["keep_id"], r["size"])
                else:
                    again.append(r)
        rows = [tuple(r[n] for n in names) for r in again if r["body"] == again[0]["body"]] if again else []
        rest = [tuple(r[n] for n in names) for r in again if again and r["body"] != again[0]["body"]]
        if rest:  # another round deals them apart
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rest)], names)
            for out in exact_dedup._owner_tries(1 << 20)(iter([batch])):
                settled |= {r["token"]: (r["keep_id"], r["size"]) for r in out.to_pylist()}
        salt += 1
        assert salt < 9
    assert settled == {100: (0, 2), 102: (0, 2), 101: (1, 2), 104: (1, 2), 103: (3, 1)}


def test_memory_of_a_trie_is_what_it_counts():
    """Short keys are mostly nodes: the count that bounds a trie follows what Python really holds."""
    import tracemalloc

    rng = random.Random(2)
    keys = [bytes(rng.randrange(256) for _ in range(16)) for _ in range(20_000)]
    tracemalloc.start()
    trie = exact_dedup.PatriciaTrie()
    for n, k in enumerate(keys):
        trie.node(k).value = (n, (16, n, n), 1, (16, n))
        trie.terminals += 1
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert 0.8 * held < trie.memory < 2.5 * held
    before = trie.memory
    _, out = trie.spill()
    assert out and trie.memory < before and trie.terminals == len(keys) - len(out)


def test_short_texts_stay_within_the_bound(spark):
    """Many short texts twice over, under a bound that a few hundred of them fill."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "substring(md5(cast(id % 3000 AS string)), 1, 9) AS text")
    out = exact_dedup.exact_dedup(docs, trie_bytes=200 * exact_dedup.NODE_BYTES)
    assert out.filter("kept").count() == 3000 == out.filter("kept AND group_size = 2 AND doc_id < 3000").count()
