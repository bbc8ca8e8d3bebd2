import random

from peerlens.operators import graph
from peerlens.sources.tables import bucketed


def test_edges_and_masks(spark):
    rows = [("a", 0, "b", False), ("a", 1, "b", False), ("a", 3, None, True), ("a", 15, None, True), ("b", 2, "c", False)]
    probes = spark.createDataFrame(rows, "peer string, cpl int, neighbour string, failed boolean")
    assert sorted(map(tuple, graph.neighbour_edges(probes).collect())) == [("a", "b"), ("b", "c")]
    assert dict(map(tuple, graph.neighbour_errors(probes).collect())) == {"a": 8 + 2**15, "b": 0}


def test_frontier_equals_breadth_first_search(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(80), rng.randrange(80)) for _ in range(120)}
    edges |= {(0, n) for n in range(30)} | {(i, i + 1) for i in range(80, 90)} | {(5, 80)}
    rounds, frontier, n = {0: 0}, {0}, 0
    while frontier:
        n += 1
        frontier = {b for a, b in edges if a in frontier} - set(rounds)
        rounds.update({p: n for p in frontier})
    df = spark.createDataFrame(sorted(edges), "peer bigint, neighbour bigint").repartition(5)
    seeds = spark.createDataFrame([(0,), (0,)], "peer bigint")
    assert dict(map(tuple, graph.crawl_frontier(df, seeds).collect())) == rounds


def test_a_round_moves_the_frontier_only(spark):
    """With sort-merge joins throughout, the one exchange of a round is that of the reached neighbours."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = bucketed(spark.range(500).selectExpr("id AS peer", "id * 7 % 500 AS neighbour"), "peer")
        known = [bucketed(spark.range(n, n + 3).selectExpr("id AS peer"), "peer") for n in (0, 40)]
        fresh = graph.reached(edges, known[-1])
        for delta in known:
            fresh = fresh.join(delta, "peer", "left_anti")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 1
        assert {r.peer for r in fresh.collect()} == {n * 7 % 500 for n in (40, 41, 42)} - {0, 1, 2, 40, 41, 42}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
