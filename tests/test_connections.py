import datetime as dt
import random

import pytest

from peerlens.operators import connections, timeline
from pyspark.sql import functions as F

T0 = dt.datetime(2022, 10, 12)
SCHEMA = ("peer_id string, kind string, ts timestamp, seq bigint, direction int, latency_ns bigint, "
          "identified boolean, error string")


def half(peer, kind, seconds, seq, **extra):
    base = dict(direction=1, latency_ns=100_000, identified=True, error="None") if kind == "open" else {}
    base.update(extra)
    return (peer, kind, T0 + dt.timedelta(seconds=seconds), seq, base.get("direction"),
            base.get("latency_ns"), base.get("identified"), base.get("error"))


def pairs(halves):
    """Opens followed by a later close, peer by peer."""
    out = set()
    for peer in {h[0] for h in halves}:
        rows = sorted((h for h in halves if h[0] == peer), key=lambda h: (h[2], h[3]))
        for a, b in zip(rows, rows[1:]):
            if a[1] == "open" and b[1] == "close" and b[2] > a[2]:
                out.add((peer, a[3], b[2]))
    return out


def found(df, **kwargs):
    return {(r.peer_id, r.seq, r.ts) for r in connections.pair_conn_events(df, **kwargs).collect()}


def test_known_connection(spark):
    rows = [half("p", "open", 0, 1), half("p", "close", 7200, 2)]
    r = connections.pair_conn_events(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.direction, r.latency, r.disconn_time - r.conn_time) == ("inbound", 0, 7200)
    assert (r.identified, r.error) == (True, "None")


def test_odd_sequences(spark):
    rows = [
        half("late", "close", 100, 1), half("late", "open", 50, 2),  # close arrives first
        half("two", "open", 0, 3), half("two", "close", 5, 4), half("two", "open", 9, 5), half("two", "close", 12, 6),
        half("orphan", "open", 0, 7), half("orphan", "open", 10, 8), half("orphan", "close", 20, 9),
        half("lone", "close", 0, 10),
        half("short", "open", 0.25, 11), half("short", "close", 0.75, 12),
        half("zero", "open", 1, 13), half("zero", "close", 1, 14),
    ]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert {(p, s) for p, s, _ in got} == {("late", 2), ("two", 3), ("two", 5), ("orphan", 8), ("short", 11)}


@pytest.mark.parametrize("slice_seconds", [10, 3600, 10**9])
def test_hot_peer_any_slicing(spark, slice_seconds):
    rng = random.Random(5)
    rows = [
        half("hot" if rng.random() < 0.5 else f"p{rng.randrange(20)}", rng.choice(["open", "close"]),
             rng.randrange(20000), i)
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(df, slice_seconds=slice_seconds) == pairs(rows)


def test_latest_before(spark):
    rng = random.Random(9)
    rows = [(f"p{rng.randrange(3)}", T0 + dt.timedelta(seconds=t), t, rng.random() < 0.1)
            for t in rng.sample(range(50000), 600)]
    df = spark.createDataFrame(rows, "peer_id string, ts timestamp, seq bigint, ok boolean")
    got = timeline.with_latest_before(df, "peer_id", F.when(F.col("ok"), F.col("seq")), "latest", 500)
    for r in got.collect():
        before = [s for p, _, s, ok in rows if p == r.peer_id and ok and s <= r.seq]
        assert r.latest == (max(before) if before else None)
