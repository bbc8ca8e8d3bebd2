"""Shape of the physical plans."""

import pytest

import __spark_entry__ as entry

# Queries that run jobs of their own while they are built are planned elsewhere.
LAZY = [
    "client_distribution", "geo_distribution", "hosting_distribution", "country_stats", "client_stats",
    "peer_locations", "all_ips", "ip_overlap", "geo_coverage", "pair_conn_events", "fold_eth_status",
    "insert_attestations", "messages_per_topic", "neighbour_edges", "timed_attestations_batch", "metrics_snapshot",
]


def plan(spark, data, name):
    if name == "timed_attestations_batch":
        name = "attestation_event_json"
    return entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_no_cross_join(spark, data, name):
    text = plan(spark, data, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert bad not in text


def test_only_needed_columns_are_read(spark, data):
    text = plan(spark, data, "client_distribution")
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text
    # Listed peers need no activity, so the orders are not read at all.
    assert "o_orderdate" not in plan(spark, data, "country_stats")


def test_peers_are_counted_before_the_join(spark, data):
    text = plan(spark, data, "geo_distribution")
    joined = text[text.index("Join"):]
    assert "partial_count(1)" in joined
    assert plan(spark, data, "hosting_distribution").count("Scan parquet") <= 6


def test_pairing_shuffles_by_key_and_slice(spark, data):
    text = plan(spark, data, "pair_conn_events")
    assert "hashpartitioning(peer_id" in text and "_slice" in text
