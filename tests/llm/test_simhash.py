"""SimHash components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from peerlens.llm import simhash
from peerlens.llm.common import cut, table
from peerlens.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(values):
    """Root of every value under links of two bits or fewer, by all pairs."""
    values = sorted(set(values))
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    array = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(array ^ array[i]) <= 2)[0].tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {v: find(i) for i, v in enumerate(values)}


def check(df, rows):
    prints = [fingerprint(t) for _, t in rows]
    root = joined(prints)
    least = {}
    for (doc, _), fp in zip(rows, prints):
        if doc is not None:
            least[root[fp]] = min(doc, least.get(root[fp], doc))
    expected = sorted(((doc, f"{fp:016x}", least.get(root[fp])) for (doc, _), fp in zip(rows, prints)), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == expected


def test_whole_table(spark, data):
    docs = table(spark, data, "documents")
    check(simhash.simhash_components(docs), [(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    rows = [(4, None), (3, ""), (9, " \n"), (5, "one"), (6, "ONE"), (7, "one two"), (8, "one two"), (None, "alone here now"),
            (2, "x " * 200_000), (1, "x " * 150_000), (1, "again"), (1, "again"), (None, "")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    check(simhash.simhash_components(docs), rows)
    left = simhash.drop_near(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 1, 1, 3, 5, 7, 8]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell_limit", [simhash.CELL_LIMIT, 20])
def test_dense_cluster(spark, cell_limit):
    rng = random.Random(1)
    values = [rng.getrandbits(64)]
    while len(values) < 1500:
        v = rng.choice(values[:300])
        for _ in range(rng.randint(1, 3)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    labels = {r.node: r.label for r in components(cut(simhash.near_links(nodes, cell_limit))).collect()}
    root = joined(values)
    by_root, by_label = {}, {}
    for v in signed:
        by_root.setdefault(root[v & (1 << 64) - 1], set()).add(v)
        by_label.setdefault(labels.get(v, v), set()).add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_label.values()))


def test_masks_and_blocks_agree(monkeypatch):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(50)}
    for v in list(values):
        values.add(v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    values = np.array(sorted(values), np.uint64)
    whole = [x.tolist() for x in simhash.star_links(values)]
    monkeypatch.setattr(simhash, "CELL_LIMIT", 2)
    assert [x.tolist() for x in simhash.star_links(values)] == whole and whole[0]


def test_rows_without_or_with_shared_ids_are_told_apart(spark):
    near = "a b c d e f g h"
    rows = [(1, near), (None, near.upper()), (None, "stands quite alone"), (7, "one text here"), (7, "another thing there"),
            (3, "under this id"), (8, "UNDER this id"), (8, "not like it"), (5, "TWO words"), (5, "two words"),
            (None, "no id at all"), (None, "NO id at all"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in simhash.drop_near(docs).collect()]
    sole = {(1, near), (None, "stands quite alone"), (7, "one text here"), (7, "another thing there"), (3, "under this id"), (8, "not like it")}
    assert sole <= set(left) and len(left) == len(sole) + 3
    for group in ({(5, "TWO words"), (5, "two words")}, {(None, "no id at all"), (None, "NO id at all")}, {(9, None), (9, "")}):
        assert len(group & set(left)) == 1
