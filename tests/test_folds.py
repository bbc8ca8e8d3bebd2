import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from peerlens.operators import folds, lookups
from peerlens.plans.queries import Inputs

T0 = dt.datetime(2024, 1, 1)
HOST = "peer_id string, ts timestamp, seq bigint, network string, multi_addrs array<string>, ip string, port int"
PEER = ("peer_id string, ts timestamp, seq bigint, user_agent string, client_name string, client_version string, "
        "client_os string, client_arch string, protocol_version string, sup_protocols array<string>, latency int")
TRY = "peer_id string, ts timestamp, seq bigint, status string, error string, deprecable boolean"
CONN = "peer_id string, ts timestamp, seq bigint, disconn_time bigint"


def at(n):
    return T0 + dt.timedelta(seconds=n)


def host(peer, n, network="Ethereum CL", ip="192.168.1.1"):
    return (peer, at(n), n, network, [f"/ip4/{ip}/tcp/9000"], ip, 9000)


def answer(peer, n, agent="Lighthouse/v1"):
    return (peer, at(n), n, agent, agent.split("/")[0].lower(), "v1", "linux", "x86_64", "1.0", ["a", "b", "c"], 1)


def epoch(n):
    return int((at(n) - dt.datetime(1970, 1, 1)).total_seconds())


def state(spark, hosts, answers=(), tries=(), conns=(), prior=None):
    def df(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    out = folds.fold_peer_state(df(hosts, HOST), df(answers, PEER), df(tries, TRY), df(conns, CONN), prior)
    return {r.peer_id: r for r in out.collect()}


def test_host_answer_attempt(spark):
    got = state(spark, [host("p", 1)], [answer("p", 2)], [("p", at(3), 3, "positive", "None", False)])["p"]
    assert (got.ip, got.port, got.network, got.deprecated) == ("192.168.1.1", 9000, "Ethereum CL", False)
    assert (got.user_agent, got.latency, len(got.sup_protocols)) == ("Lighthouse/v1", 1, 3)
    # A success sets the activity, to the attempt's time.
    assert got.attempted and got.last_activity == got.last_conn_attempt == epoch(3)


def test_network_is_first_address_is_last(spark):
    got = state(spark, [host("p", 2, "Polygon", "1.1.1.1"), host("p", 1), host("p", 3, "Celo", "2.2.2.2")])["p"]
    assert (got.network, got.ip) == ("Ethereum CL", "2.2.2.2")


def test_writes_before_the_peer_exists_are_lost(spark):
    got = state(
        spark, [host("p", 5)], [answer("p", 4), answer("q", 4)],
        [("p", at(3), 3, "positive", "none", False)], [("p", at(2), 2, 77)],
    )
    assert set(got) == {"p"}
    p = got["p"]
    assert (p.user_agent, p.attempted, p.last_activity, p.last_error) == (None, None, None, None)


def test_last_written_activity_wins_not_the_greatest(spark):
    tries = [("p", at(9), 9, "positive", "none", False), ("p", at(11), 11, "negative", "io_timeout", True)]
    got = state(spark, [host("p", 1)], (), tries, [("p", at(10), 10, 4)])["p"]
    assert got.last_activity == 4 and got.last_conn_attempt == epoch(11)
    assert got.deprecated and got.last_error == "io_timeout"
    again = state(spark, [host("p", 1), host("p", 12)], (), tries)["p"]
    assert again.deprecated is False


def test_prior_state_continues(spark):
    prior = spark.createDataFrame(
        [tuple(r) for r in state(spark, [host("p", 1)], [answer("p", 2)]).values()],
        "peer_id string, network string, multi_addrs array<string>, ip string, port int, user_agent string, "
        "client_name string, client_version string, client_os string, client_arch string, protocol_version string, "
        "sup_protocols array<string>, latency int, deprecated boolean, attempted boolean, last_activity bigint, "
        "last_conn_attempt bigint, last_error string",
    )
    got = state(spark, [host("n", 3)], [answer("p", 4, "Prysm/v2")], [], [], prior)
    assert got["p"].client_name == "prysm" and got["p"].network == "Ethereum CL" and set(got) == {"p", "n"}
    # Folding nothing changes nothing.
    same = state(spark, [], prior=prior)
    assert same["p"] == prior.first()


@pytest.mark.parametrize("seed", [1, 2])
def test_any_partitioning_gives_the_same_state(spark, data, seed):
    b = Inputs(spark, data)
    _, answers, _, _ = b.identified()
    parts = [b.hosts, answers, b.attempts.withColumn("deprecable", F.lit(False)), b.conn_events()]

    def run(shuffle):
        ins = [p.repartition(shuffle, F.rand(seed)) if shuffle else p for p in parts]
        return sorted(folds.fold_peer_state(*ins).collect())

    assert run(0) == run(7)


def test_status_and_metadata_are_independent(spark):
    status = spark.createDataFrame(
        [("p", at(1), 1, "d1", "r", 5, "h", 10), ("p", at(5), 5, "d2", "r", 6, "h", 11)],
        "peer_id string, ts timestamp, seq bigint, fork_digest string, finalized_root string, "
        "finalized_epoch bigint, head_root string, head_slot bigint")
    metadata = spark.createDataFrame(
        [("p", at(9), 9, 3, "ff", "0"), ("q", at(2), 2, 1, "0f", "0")],
        "peer_id string, ts timestamp, seq bigint, seq_number bigint, attnets string, syncnets string")
    got = {r.peer_id: r for r in folds.fold_eth_status(status, metadata).collect()}
    assert (got["p"].timestamp, got["p"].head_slot, got["p"].seq_number) == (epoch(9), 11, 3)
    assert (got["q"].fork_digest, got["q"].seq_number) == (None, 1)
    later = folds.fold_eth_status(status.limit(0), metadata.limit(0), folds.fold_eth_status(status, metadata))
    assert sorted(later.collect()) == sorted(got.values())


def nodes(spark, rows):
    return spark.createDataFrame(
        [(t, o, p, n, s, "i", 1, 1, k, "f" + str(o), "v", "a", 1) for o, (t, p, n, s, k) in enumerate(rows)],
        "timestamp bigint, ord bigint, peer_id string, node_id string, seq bigint, ip string, tcp int, udp int, "
        "pubkey string, fork_digest string, next_fork_version string, attnets string, attnets_number int")


def test_node_records(spark):
    df = nodes(spark, [(1, "p", "n1", 9, "k"), (2, "x", "n1", 3, "y"), (3, "p", "n2", 1, "k"), (4, "q", "n3", 1, "k")])
    last = {r.node_id: r for r in folds.fold_eth_nodes(df).collect()}
    assert set(last) == {"n1", "n3"}
    assert (last["n1"].peer_id, last["n1"].pubkey, last["n1"].seq, last["n1"].fork_digest) == ("p", "k", 3, "f1")
    by_seq = {r.node_id: r for r in folds.fold_eth_nodes(df, by="seq").collect()}
    assert by_seq["n1"].seq == 9
    assert [tuple(r) for r in folds.dq_eth_node_conflicts(df).collect()] == [("n2", "p", "k", "n1")]


def test_prior_tables_continue(spark, data):
    b = Inputs(spark, data)
    whole = folds.fold_eth_nodes(b.records)
    early, late = b.records.filter("ord < 90"), b.records.filter("ord >= 90")
    for by in ("arrival", "seq"):
        step = folds.fold_eth_nodes(late, by, folds.fold_eth_nodes(early, by))
        assert sorted(step.collect(), key=str) == sorted(folds.fold_eth_nodes(b.records, by).collect(), key=str)
    assert whole.count() > 0
    log = spark.createDataFrame([("a", 1, at(1), 1), ("a", 2, at(2), 2), ("b", 3, at(3), 3)],
                                "ip string, v int, ts timestamp, seq int")
    prior = spark.createDataFrame([("a", 9), ("c", 9)], "ip string, v int")
    assert {tuple(r) for r in folds.fold_ips(log, prior).collect()} == {("a", 2), ("b", 3), ("c", 9)}


def test_snapshot_is_skipped_when_empty_and_chunked(spark):
    rows = [(i, False, True, "c", epoch(0)) for i in range(25)]
    schema = "id int, deprecated boolean, attempted boolean, client_name string, last_activity bigint"
    peers = spark.createDataFrame(rows, schema)
    now = "2024-01-02 00:00:00"
    chunks = folds.active_peers_snapshot(peers, now, chunk=10).orderBy("chunk").collect()
    assert [c.peers for c in chunks] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert folds.active_peers_snapshot(peers, "2026-01-01", chunk=10).count() == 0
    named = peers.withColumn("peer_id", F.col("id").cast("string"))
    back = folds.snapshot_explode(folds.active_peers_snapshot(peers, now, 10), named, now)
    assert back.count() == 25


def test_first_message_wins(spark):
    rng = random.Random(3)
    rows = [(f"m{rng.randrange(5)}", f"s{i}", rng.choice([0, 7]), at(rng.randrange(50)), i) for i in range(80)]
    df = spark.createDataFrame(rows, "msg_id string, sender string, slot bigint, arrival_time timestamp, seq bigint")
    got = {r.msg_id: r.sender for r in folds.first_by_message(df).collect()}
    want = {}
    for m, s, slot, ts, i in sorted(rows, key=lambda r: (r[3], r[4])):
        if slot:
            want.setdefault(m, s)
    assert got == want
    known = spark.createDataFrame([("m0",)], "msg_id string")
    assert "m0" not in {r.msg_id for r in folds.insert_blocks(df, known).collect()}


def test_geolocation_cache_life_cycle(spark):
    ips = spark.createDataFrame([("1.1.1.1", dt.datetime(2024, 3, 1)), ("2.2.2.2", dt.datetime(2024, 1, 1))],
                                "ip string, expiration_time timestamp")
    now = "2024-02-01 00:00:00"
    keys = spark.createDataFrame([("1.1.1.1",), ("2.2.2.2",), ("3.3.3.3",)], "ip string")
    got = {r.ip: (r.record_exists, r.record_expired) for r in lookups.ip_record_status(keys, ips, now).collect()}
    assert got == {"1.1.1.1": (True, False), "2.2.2.2": (True, True), "3.3.3.3": (False, False)}
    assert [r.ip for r in lookups.expired_ips(ips, now).collect()] == ["2.2.2.2"]
    asked = keys.unionByName(keys).unionByName(spark.createDataFrame([("10.0.0.1",), ("",)], "ip string"))
    assert [r.ip for r in lookups.ips_to_locate(asked, ips, now).collect()] == ["2.2.2.2", "3.3.3.3"]
    assert [r.ip for r in lookups.ips_to_locate(asked, ips, now, batch=1).collect()] == ["2.2.2.2"]


def test_discoveries_keep_first_and_order(spark):
    rows = [(f"p{i % 3}", at(i), i, f"/ip4/192.168.0.1{i}/tcp/9000") for i in range(9)]
    df = spark.createDataFrame(rows, "peer_id string, ts timestamp, seq bigint, multi_addr string").repartition(4)
    got = lookups.discovered_dedup(df).orderBy("seq").collect()
    assert [(r.peer_id, r.seq) for r in got] == [("p0", 0), ("p1", 1), ("p2", 2)]


def test_addresses_are_cleaned_not_peers(spark):
    rows = [("p", "N", ["/ip4/1.1.1.1/tcp/1", "bad", "/ip4"], False), ("", "N", [], False), ("d", "N", [], True)]
    df = spark.createDataFrame(rows, "peer_id string, network string, multi_addrs array<string>, deprecated boolean")
    assert [tuple(r) for r in lookups.connectable_peers(df, "N").collect()] == [("p", "N", ["/ip4/1.1.1.1/tcp/1"])]
    known = lookups.peer_exists(spark.createDataFrame([("p",), ("x",)], "peer_id string"), df)
    assert {r.peer_id: r.peer_exists for r in known.collect()} == {"p": True, "x": False}


def test_nodes_with_null_keys_are_all_kept(spark):
    rows = [(i, f"n{i}", None if i % 2 else "p", None if i % 3 == 0 else "k") for i in range(12)]
    fields = "timestamp bigint, seq bigint, ip string, tcp int, udp int, fork_digest string, next_fork_version string, attnets string, attnets_number int"
    events = spark.createDataFrame(rows, "ord bigint, node_id string, peer_id string, pubkey string")
    for field in fields.split(", "):
        name, kind = field.split()
        events = events.withColumn(name, F.lit(1).cast(kind))
    whole = [r for r in rows if r[2] and r[3]]
    kept = folds.fold_eth_nodes(events)
    assert kept.count() == len(rows) - len(whole) + 1
    turned = folds.dq_eth_node_conflicts(events)
    assert sorted(r.node_id for r in turned.collect()) == sorted(r[1] for r in whole[1:])
    assert {r.owner for r in turned.collect()} == {whole[0][1]}


def test_past_networks(spark):
    """Runs of snapshots per peer, and the newest snapshot not after a moment."""
    stamps = [f"2024-01-0{d} 00:00:00" for d in range(1, 6)]
    present = {0: [1, 2], 1: [1], 2: [1, 2, 3], 3: [2], 4: [1, 2]}
    rows = [(stamps[n], c, [i for i in ids if i % 2 == c]) for n, ids in present.items() for c in (0, 1)]
    snapshots = spark.createDataFrame(rows, "t string, chunk int, peers array<long>").selectExpr("cast(t AS timestamp) AS timestamp", "chunk", "peers")
    got = sorted((r.id, r.present_from.day, r.present_to.day, r.snapshots) for r in folds.presence_intervals(snapshots).collect())
    assert got == [(1, 1, 3, 3), (1, 5, 5, 1), (2, 1, 1, 1), (2, 3, 5, 3), (3, 3, 3, 1)]
    peers = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id int, peer_id string")
    at = lambda t: sorted(r.peer_id for r in folds.network_at(snapshots, peers, t).collect())
    assert at("2024-01-02 13:00:00") == ["p1"] and at("2024-01-03 00:00:00") == ["p1", "p2", "p3"]
    assert at("2023-12-31 00:00:00") == [] and at("2030-01-01 00:00:00") == ["p1", "p2"]
