"""Retry state against a step-by-step replay, with a hot peer."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.operators import retry
from peerlens.plans.policy import DEFAULT_POLICY, RetryPolicy

START = dt.datetime(2024, 1, 1)
DAY = 86400


def replay(attempts, hosts, policy):
    """Final (life, class, degree, next, deprecable, error) of every peer."""
    classes = {code: name for name, codes in policy.classes for code in codes}
    log = [(ts, seq, "host", None, p) for p, ts, seq in hosts]
    log += [(ts, seq, "dial", error, p) for p, ts, seq, error in attempts]
    state = {}
    for ts, seq, kind, error, p in sorted(log):
        s = state.get(p)
        if kind == "host":
            if s is None or s["dead"]:
                life = 1 if s is None else s["life"] + 1
                state[p] = dict(life=life, cls="Minus1", degree=0, base=ts, last=None, dead=False, error="--")
            continue
        if s is None or s["dead"]:
            continue
        cls = classes.get(error, policy.default_class)
        s["degree"] = s["degree"] + 1 if cls == s["cls"] else 1
        s["cls"], s["error"], s["last"] = cls, error, ts
        if cls == policy.positive_class:
            s["base"] = ts
        s["dead"] = (ts - s["base"]).total_seconds() >= policy.deprecate_after
    out = {}
    for p, s in state.items():
        nxt = None
        if s["last"]:
            wait = policy.base_seconds.get(s["cls"], 0)
            if s["cls"] in policy.growing:
                wait *= 2 ** (s["degree"] - 1)
            nxt = s["last"] + dt.timedelta(seconds=min(wait, policy.max_seconds))
        out[p] = (s["life"], s["cls"], s["degree"], nxt, s["dead"], s["error"])
    return out


def logs(seed, peers=12, n=900):
    rng = random.Random(seed)
    attempts, hosts = [], []
    times = rng.sample(range(40 * DAY), n)
    for seq, offset in enumerate(sorted(times)):
        peer = "hot" if rng.random() < 0.4 else f"p{rng.randrange(peers)}"
        ts = START + dt.timedelta(seconds=offset)
        if rng.random() < 0.15:
            hosts.append((peer, ts, seq))
        else:
            attempts.append((peer, ts, seq, rng.choice(
                ["none", "io_timeout", "io_timeout", "connection_refused", "no_route_to_host", "None"])))
    return attempts, hosts


@pytest.mark.parametrize("days,seed", [(30, 1), (3, 2), (1, 3)])
def test_state_equals_replay(spark, days, seed):
    policy = RetryPolicy(deprecate_after=days * DAY)
    attempts, hosts = logs(seed)
    a = spark.createDataFrame(attempts, "peer_id string, ts timestamp, seq bigint, error string").repartition(5)
    h = spark.createDataFrame(hosts, "peer_id string, ts timestamp, seq bigint").repartition(3)
    got = {
        r.peer_id: (r.life, r.delay_class, r.degree, r.next_attempt, r.deprecable, r.last_error)
        for r in retry.peer_retry_state(a, h, policy).collect()
    }
    assert got == replay(attempts, hosts, policy)


def test_long_timeout_run_is_capped(spark):
    degrees = spark.range(1, 80).select(F.col("id").cast("int").alias("d"))
    got = {
        r.d: r.w
        for r in degrees.select("d", DEFAULT_POLICY.delay(F.lit("Timeout"), F.col("d")).alias("w")).collect()
    }
    for d, wait in got.items():
        assert wait == min(1920 * 2 ** (d - 1), 2048 * 60)
    flat = degrees.limit(1).select(
        *[DEFAULT_POLICY.delay(F.lit(c), F.col("d")) for c in (D.POSITIVE, D.HOPE, D.NO_HOPE, D.FRESH)]
    ).first()
    assert tuple(flat) == (120, 120, 0, 0)


def test_life_cycle(spark):
    """Given up after 30 days without success; a rediscovery starts afresh."""
    def at(days):
        return START + dt.timedelta(days=days)

    hosts = [("a", at(0), 0), ("a", at(50), 5), ("b", at(0), 6)]
    attempts = [("a", at(1), 1, "none"), ("a", at(20), 2, "io_timeout"), ("a", at(31), 3, "io_timeout"),
                ("a", at(40), 4, "none"), ("a", at(51), 7, "connection_refused"), ("z", at(1), 8, "none")]
    a = spark.createDataFrame(attempts, "peer_id string, ts timestamp, seq bigint, error string")
    h = spark.createDataFrame(hosts, "peer_id string, ts timestamp, seq bigint")
    history = {(r.peer_id, r.life): r for r in retry.retry_history(a, h).collect()}
    assert set(history) == {("a", 1), ("a", 2), ("b", 1)}
    assert history["a", 1].deprecable and history["a", 1].last_attempt == at(31)
    assert history["a", 1].degree == 2
    assert not history["a", 2].deprecable and history["a", 2].delay_class == D.HOPE
    assert history["b", 1].delay_class == D.FRESH and history["b", 1].next_attempt is None
    state = retry.peer_retry_state(a, h)
    queue = [r.peer_id for r in retry.ready_queue(state, "2024-03-01").collect()]
    assert queue == ["b", "a"]
    assert [r.peer_id for r in retry.ready_queue(state, "2024-02-21 00:01:00").collect()] == ["b"]
