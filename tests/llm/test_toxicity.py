"""Nearest labelled examples: exact neighbours, held-out accuracy, and labels that must teach nothing."""

import zlib

import numpy as np
import pytest

from peerlens.llm import toxicity
from peerlens.llm.common import table


def make(n, seed, terms=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        held = np.unique(np.concatenate([rng.integers(0, terms // 2, 2) + (0 if toxic else terms // 2), [terms]]))
        counts = rng.integers(1, 5, len(held))
        counts[-1] = rng.integers(20, 400)
        rows.append((i, held.tolist(), counts.tolist(), float(toxic)))
    return rows


def plainly(index, terms, counts, k, leave=None):
    _, value = index.unit(np.array(terms), np.array(counts))
    query = np.zeros(len(index.idf))
    query[terms] = value
    n = len(index.ids)
    dense = np.zeros((n, len(index.idf)))
    for t in range(len(index.idf)):
        low, high = index.at[t * index.blocks], index.at[(t + 1) * index.blocks]
        dense[index.place[low:high], t] = index.value[low:high]
    cosines = dense @ query
    if leave is not None:
        cosines[leave] = 0
    kth = np.sort(cosines)[-k] if n >= k else 0
    return {int(i): c for i, c in enumerate(cosines) if c > 1e-9 and c >= kth - 1e-9}


def test_neighbours_are_exact_and_blocks_are_skipped():
    rows = make(900, 1)
    index = toxicity.Index(rows, np.linspace(4, 1, 13), {True: 180, False: 720}, 16)
    index.visited, asked = 0, 0
    for _, t, c, _ in make(80, 2) + [(0, [12], [9], 0.0), (0, [0], [1], 0.0), (0, [0, 11], [1, 1], 0.0)]:
        places, cosines = index.neighbours(*index.unit(np.array(t), np.array(c)))
        expected = plainly(index, t, c, 16)
        assert set(places.tolist()) == set(expected)
        assert np.allclose([expected[p] for p in places.tolist()], cosines)
        asked += index.blocks
    assert index.visited < 0.7 * asked
    for i in range(0, 900, 90):
        _, t, c, _ = rows[index.ids[i]]
        places, _ = index.neighbours(*index.unit(np.array(t), np.array(c)), leave=i)
        assert i not in places and set(places.tolist()) == set(plainly(index, t, c, 16, i))


def test_votes_weights_and_calibration():
    rows = make(900, 3)
    index = toxicity.Index(rows, np.linspace(4, 1, 13), {True: 180, False: 72_000}, 16)
    assert index.prior == pytest.approx(180 / 72_180)
    x, y = index.points
    assert np.all(np.diff(x) > 0) and np.all(np.diff(y) >= 0) and 0 <= y[0] <= y[-1] <= 1
    assert index.score(np.zeros(0, np.int64), np.zeros(0, np.int64)) == (index.prior, [])
    score, evidence = index.score(np.array([1, 2, 12]), np.array([4, 4, 40]))
    assert score > 0.5 and len(evidence) == toxicity.EVIDENCE and all(e["label"] == 1 for e in evidence)


def test_held_out_accuracy(spark, data):
    folder = data.replace("0.001", "0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = toxicity.toxicity(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    caught = [r.predicted for r in held if truth[r.doc_id] == 1]
    clean = [1 - r.predicted for r in held if truth[r.doc_id] == 0]
    assert sum(caught) / len(caught) >= 0.85 and sum(clean) / len(clean) >= 0.985


def test_held_out_labels_teach_nothing(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    other = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic"
    )
    pick = ["doc_id", "score"]
    before = toxicity.toxicity(docs, labels).select(pick).collect()
    after = toxicity.toxicity(docs.repartition(5).withColumn("toxic", docs["doc_id"]), other).select(pick).collect()
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))


def test_edges(spark, data):
    rows = [(i, f"kind words here {'bad' if i % 4 == 0 else 'good'} w{i} w{i % 9}") for i in range(1, 240)]
    rows += [(500, None), (501, ""), (502, "!!"), (None, "kind bad words"), (503, "BAD bad"), (503, "BAD bad"), (504, "ok " * 100_000 + "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS term", "'x' AS digest", "2 AS toxic", "3 AS share")
    marks = [(i, int(i % 4 == 0), "x") for i in range(1, 240)] + [(4, 0, "x"), (8, None, "x"), (9, 7, "x"), (None, 1, "x"), (9999, 1, "x")]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text string")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[500].score == by[501].score == by[502].score and 0 < by[500].score < 0.5
    assert by[503].predicted == 1 and by[None].predicted == 1 and not by[None].held_out
    assert by[1].predicted == 0 and by[4].predicted == 1
    empty = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(empty) == len(rows) and {(r.score, r.predicted) for r in empty} == {(0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    one_class = toxicity.toxicity(docs, labels.filter("toxic = 1")).collect()
    assert {r.predicted for r in one_class} == {1}
