"""Per-peer retry state, deprecation and the dial queue.

A peer's *life* starts at a discovery and ends at the failed attempt that comes
too long after the last success (or after the start).  Attempts outside a life
concern peers that are not in the queue and are ignored.

No step gathers a peer's history: lives come from minima and the state from
mergeable aggregates, which combine on the map side, and joins back to the
attempts are salted.  A peer with a third of all attempts stays spread.
"""

from functools import reduce

from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.operators.skew import salted_join
from peerlens.operators.timeline import with_latest_before
from peerlens.plans.policy import DEFAULT_POLICY
from peerlens.session import cut


POSITION = ("ts", "seq")


def _ord():
    return F.struct(*POSITION)


def _until(df, as_of):
    return df if as_of is None else df.filter(F.col("ts") <= F.lit(as_of).cast("timestamp"))


def stale_failures(attempts, policy=DEFAULT_POLICY):
    """Failed attempts with no success in the deprecation period before them."""
    positive = policy.class_of(F.col("error")) == policy.positive_class
    marked = with_latest_before(
        attempts.select("peer_id", "ts", "seq", "error"),
        "peer_id",
        F.when(positive, F.unix_micros("ts")),
        "success_us",
    )
    limit = policy.deprecate_after * 1_000_000
    overdue = F.col("success_us").isNull() | (F.unix_micros("ts") - F.col("success_us") >= limit)
    return marked.filter(~positive & overdue).select("peer_id", "ts", "seq")


def peer_lives(attempts, hosts, policy=DEFAULT_POLICY, as_of=None):
    """One row per life: peer_id, life, start and (or NULL) end position.

    A life ends at the first stale failure at least the deprecation period
    after its start; the next one starts at the first later discovery.  Round k
    finds the k-th life of every peer at once, and only peers that came back
    take part in the next round: a life lasts at least the deprecation period,
    so the number of rounds is bounded by the covered time, not by the data.
    """
    attempts, hosts = _until(attempts, as_of), _until(hosts, as_of)
    limit = policy.deprecate_after * 1_000_000
    found = hosts.select("peer_id", "ts", "seq")
    first = found.groupBy("peer_id").agg(F.min(_ord()).alias("start"))
    overdue = (_ord() > F.col("start")) & (
        F.unix_micros("ts") - F.unix_micros("start.ts") >= limit
    )
    # No life ends before the first one could; usually that leaves next to nothing.
    stale = cut(
        salted_join(stale_failures(attempts, policy), first, "peer_id", POSITION).filter(overdue),
        "stale",
    )
    no_end = F.lit(None).cast("struct<ts:timestamp,seq:bigint>").alias("end")
    if stale.isEmpty():
        return first.select("peer_id", F.lit(1).alias("life"), "start", no_end)
    # Only peers whose first life ends go through the rounds.
    begin = stale.groupBy("peer_id").agg(F.min("start").alias("start"))
    ending = begin.select("peer_id")
    lives = [
        first.join(ending, "peer_id", "left_anti").select(
            "peer_id", F.lit(1).alias("life"), "start", no_end
        )
    ]
    stale = stale.drop("start")
    found = cut(salted_join(found, ending, "peer_id", POSITION), "found")
    number = 1
    while True:
        ends = (
            salted_join(stale, begin, "peer_id", POSITION)
            .filter(overdue)
            .groupBy("peer_id")
            .agg(F.min(_ord()).alias("end"))
        )
        again = (
            salted_join(found, ends, "peer_id", POSITION)
            .filter(_ord() > F.col("end"))
            .groupBy("peer_id")
            .agg(F.min(_ord()).alias("again"))
        )
        step = begin.join(ends, "peer_id", "left").join(again, "peer_id", "left")
        step = cut(step.select("peer_id", F.lit(number).alias("life"), "start", "end", "again"), "life")
        lives.append(step.drop("again"))
        begin = step.filter(F.col("again").isNotNull()).select(
            "peer_id", F.col("again").alias("start")
        )
        if begin.isEmpty():
            break
        number += 1
    return reduce(lambda a, b: a.unionByName(b), lives)


def live_attempts(attempts, lives):
    """Attempts inside a life, with its number and whether they end it."""
    inside = (_ord() > F.col("start")) & (F.col("end").isNull() | (_ord() <= F.col("end")))
    return (
        salted_join(attempts, lives, "peer_id", POSITION)
        .filter(inside)
        .withColumn("deprecable", F.coalesce(_ord() == F.col("end"), F.lit(False)))
        .drop("start", "end")
    )


def retry_history(attempts, hosts, policy=DEFAULT_POLICY, as_of=None):
    """State at the end of every life of every peer."""
    attempts, hosts = _until(attempts, as_of), _until(hosts, as_of)
    lives = peer_lives(attempts, hosts, policy)
    live = live_attempts(attempts, lives).select(
        "peer_id", "life", "ts", "seq", "error", policy.class_of(F.col("error")).alias("cls")
    )
    # Last position of each class; the trailing run starts after all the others.
    latest = live.groupBy("peer_id", "life").agg(
        F.max_by(F.struct("cls", "error", "ts"), _ord()).alias("last"),
        *[
            F.max(F.when(F.col("cls") == name, _ord())).alias(f"last_{i}")
            for i, name in enumerate(policy.class_names)
        ],
    )
    other = F.greatest(
        *[
            F.when(F.col("last.cls") != name, F.col(f"last_{i}"))
            for i, name in enumerate(policy.class_names)
        ]
    )
    latest = latest.select("peer_id", "life", "last", other.alias("other"))
    runs = (
        salted_join(
            live.select("peer_id", "life", "ts", "seq"), latest, ["peer_id", "life"], POSITION
        )
        .filter(F.col("other").isNull() | (_ord() > F.col("other")))
        .groupBy("peer_id", "life", "last")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    state = (
        lives.join(runs, ["peer_id", "life"], "left")
        .withColumn("delay_class", F.coalesce("last.cls", F.lit(D.FRESH)))
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
    )
    wait = policy.delay(F.col("delay_class"), F.col("degree"))
    return state.select(
        "peer_id",
        "life",
        F.col("start.ts").alias("life_start"),
        "delay_class",
        "degree",
        F.col("last.ts").alias("last_attempt"),
        F.timestamp_micros(F.unix_micros("last.ts") + wait * 1_000_000).alias("next_attempt"),
        F.col("end").isNotNull().alias("deprecable"),
        F.coalesce("last.error", F.lit(D.NEVER_TRIED)).alias("last_error"),
    )


def peer_retry_state(attempts, hosts, policy=DEFAULT_POLICY, as_of=None):
    """Current state: the latest life of every peer."""
    history = retry_history(attempts, hosts, policy, as_of)
    columns = [c for c in history.columns if c != "peer_id"]
    return (
        history.groupBy("peer_id")
        .agg(F.max_by(F.struct(*columns), "life").alias("s"))
        .select("peer_id", "s.*")
    )


def queued(state):
    """Peers that are in the queue: not given up."""
    return state.filter(~F.col("deprecable"))


def deprecate_peers(attempts, hosts, policy=DEFAULT_POLICY, as_of=None):
    """Every deprecation: peer, life, and the attempt that caused it."""
    lives = peer_lives(attempts, hosts, policy, as_of)
    return lives.filter(F.col("end").isNotNull()).select(
        "peer_id",
        "life",
        F.col("start.ts").alias("life_start"),
        F.col("end.ts").alias("deprecated_at"),
    )


def ready_queue(state, as_of):
    """Queued peers due at `as_of`, never-tried ones first."""
    due = F.col("next_attempt").isNull() | (
        F.col("next_attempt") <= F.lit(as_of).cast("timestamp")
    )
    return (
        queued(state)
        .filter(due)
        .select("peer_id", "next_attempt", "delay_class", "last_error")
        .orderBy(F.col("next_attempt").asc_nulls_first(), "peer_id")
    )
