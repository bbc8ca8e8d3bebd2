"""Ranked search against a plain scoring of every document; blocks are skipped, results are whole."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from peerlens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def plainly(docs, items, top=20):
    held = [(i, Counter(split(t)), len(split(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        scores = []
        for doc, counts, n in held:
            score = 0
            for t in split(text):
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * n * n_docs) // n_terms
                    score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if null else doc, -score))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_tables_in_small_shards_and_blocks(spark, data, monkeypatch):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    expected = plainly([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(lexical.rank(docs, items)) == expected
    assert got(lexical.rank(docs.repartition(7), items, block_bytes=2000)) == expected
    assert got(lexical.rank(docs, items, top=3)) == [r for r in expected if r[1] <= 3]


def test_edges(spark):
    docs = [(1, "Red RED apple", 1), (2, "red", 1), (3, None, 1), (4, "", 1), (5, "... !", 1), (None, "red apple", 1), (6, "red apple", 1)]
    docs += [(7, "red apple", 1), (7, "red apple", 1), (8, "Äpfel äpfel red", 1), (9, "pear " * 50_000 + "apple", 1)]
    docs += [(10 + i, f"tie w{i}", 1) for i in range(60)]
    items = [(1, "apple red RED"), (1, "apple red RED"), (1, "tie"), (2, None), (3, "?!"), (None, "Äpfel"), (4, "nowhere"), (5, "äpfel pear pear")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.rank(frame, bench)) == plainly([d[:2] for d in docs], items)
    assert lexical.rank(frame.limit(0), bench).count() == 0
    assert lexical.rank(frame, bench.limit(0)).count() == 0


@pytest.mark.parametrize("seed, dense", [(1, lexical.DENSE), (2, 0)])
def test_blocks_are_skipped_only_by_exact_bounds(seed, dense, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 8)
    monkeypatch.setattr(lexical, "DENSE", dense)
    rng = np.random.default_rng(seed)
    names = [b"t%d" % i for i in range(120)]
    n = 3000
    groups = rng.integers(0, 6, n)  # documents of a group share a third of the vocabulary
    rows, term, count = [], [], []
    for r in range(n):
        chosen = np.unique(np.concatenate([groups[r] * 20 + rng.integers(0, 20, 9), rng.integers(0, 120, 2)]))
        rows += [r] * len(chosen)
        term += chosen.tolist()
        count += rng.integers(1, 9, len(chosen)).tolist()
    rows, term, count = (np.array(x, np.int64) for x in (rows, term, count))
    df = np.bincount(term, minlength=120)
    asked = [(k, names[t], int(rng.integers(1, 3))) for k in range(30) for t in k % 6 * 20 + rng.choice(20, 6, replace=False)]
    items = lexical.Items(asked, list(zip(names, df.tolist())), n, int(count.sum()))
    number = {t: i for i, t in enumerate(items.names)}
    place = np.array([number[t] for t in names])
    order = np.lexsort((place[term], rows))
    sizes = np.bincount(rows, count, n).astype(np.int64)
    ids = rng.permutation(n).tolist()
    shard = lexical.Shard(items, ids, sizes, rows[order], place[term][order], count[order])
    for key, wanted, repeats in items.items:
        query = np.zeros(120, np.int64)
        query[wanted] = repeats
        scores = np.zeros(n, np.int64)
        m = 75 + 25 * sizes * n // int(count.sum())
        np.add.at(scores, rows, query[place[term]] * items.weights[place[term]] * (10**9 * count // (1000 * count + 12 * m[rows])))
        best = sorted((-s, False, i) for s, i in zip(scores.tolist(), ids) if s > 0)[:20]
        assert shard.search(wanted, repeats, [], 20) == best
    assert shard.skipped > shard.visited // 4
    for blocks in shard.lists.values():  # a summary is the coordinatewise maximum of its block
        for b in range(blocks.n):
            index, _ = shard.entries(blocks.members(np.array([b])))
            expected = {}
            for t, v in zip(shard.term[index].tolist(), shard.value[index].tolist()):
                expected[t] = max(expected.get(t, 0), v)
            mine = blocks.blocks == b
            assert dict(zip(blocks.terms[mine].tolist(), blocks.largest[mine].tolist())) == expected
