"""Live distributions.

Peers are counted per address before they meet the geolocation cache: an
address that hosts a third of all peers is then one row in the join.
"""

from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.operators.predicates import active_peers, recent_nodes


def _count_by(df, *keys):
    """count(first key): a NULL group reports 0."""
    return df.groupBy(*keys).agg(F.count(keys[0]).alias("cnt"))


def client_distribution(peers, as_of, network=None):
    return _count_by(active_peers(peers, as_of, network), "client_name")


def version_distribution(peers, as_of, network=None):
    return _count_by(active_peers(peers, as_of, network), "client_name", "client_version").select(
        "client_name",
        "client_version",
        F.concat_ws("_", "client_name", "client_version").alias("label"),
        "cnt",
    )


def os_distribution(peers, as_of, network=None):
    return _count_by(active_peers(peers, as_of, network), "client_os")


def arch_distribution(peers, as_of, network=None):
    return _count_by(active_peers(peers, as_of, network), "client_arch")


def peers_per_ip(peers):
    return peers.groupBy("ip").agg(F.count(F.lit(1)).alias("n"))


def geo_distribution(peers, ips, as_of, network=None):
    counted = peers_per_ip(active_peers(peers, as_of, network))
    return (
        counted.join(ips.select("ip", "country_code"), "ip")
        .groupBy("country_code")
        .agg(F.sum("n").alias("cnt"))
    )


def hosting_distribution(peers, ips, as_of, network=None):
    """Always three rows, zeros included; one pass over both inputs."""
    counted = peers_per_ip(active_peers(peers, as_of, network))
    flagged = counted.join(ips.select("ip", "mobile", "proxy", "hosting"), "ip")

    def total(flag):
        return F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0))

    sums = flagged.agg(
        total("mobile").alias("mobile_ips"),
        total("proxy").alias("under_proxy"),
        total("hosting").alias("hosted_ips"),
    )
    return sums.unpivot([], ["mobile_ips", "under_proxy", "hosted_ips"], "kind", "cnt")


def latency_range(latency):
    hits = [F.when(latency.between(low, high), F.lit(name)) for low, high, name in D.RTT_BUCKETS]
    return F.coalesce(*hits, F.lit(D.RTT_REST))


def rtt_distribution(peers, as_of, network=None):
    seen = active_peers(peers, as_of, network, attempted=False)
    return seen.groupBy(latency_range(F.col("latency")).alias("latency_range")).agg(
        F.count(F.lit(1)).alias("nodes")
    )


def ip_distribution(peers, as_of, network=None):
    seen = active_peers(peers, as_of, network, attempted=False)
    per_ip = seen.groupBy("ip").agg(F.count("ip").alias("nodes_per_ip"))
    return per_ip.groupBy("nodes_per_ip").agg(F.count("nodes_per_ip").alias("number_of_ips"))


def fork_distribution(eth_nodes, as_of):
    return _count_by(recent_nodes(eth_nodes, as_of), "fork_digest")


def attnets_distribution(eth_nodes, as_of):
    return _count_by(recent_nodes(eth_nodes, as_of), "attnets_number")


def _network(peers, network):
    return peers if network is None else peers.filter(F.col("network") == network)


def deprecated_count(peers, network=None):
    return _network(peers, network).filter("deprecated").agg(F.count(F.lit(1)).alias("cnt"))


def node_distribution(peers, network=None):
    return _network(peers, network).filter(~F.col("deprecated")).agg(F.count(F.lit(1)).alias("cnt"))


# ------------------------------------------------------------ retry state


def delay_distribution(retry_state):
    return retry_state.groupBy("delay_class").agg(F.count(F.lit(1)).alias("cnt"))


def total_error_distribution(retry_state):
    error = F.coalesce("last_error", F.lit(D.NEVER_TRIED))
    return retry_state.groupBy(error.alias("error")).agg(F.count(F.lit(1)).alias("cnt"))


def attempted_in(retry_state, start, end):
    """State of the peers whose last attempt lies in [start, end)."""
    last = F.col("last_attempt")
    return retry_state.filter(
        (last >= F.lit(start).cast("timestamp")) & (last < F.lit(end).cast("timestamp"))
    )


def iteration_delay_distribution(retry_state, start, end):
    return delay_distribution(attempted_in(retry_state, start, end))


def iteration_error_distribution(retry_state, start, end):
    return total_error_distribution(attempted_in(retry_state, start, end))


def iteration_attempts(retry_state, start, end):
    return attempted_in(retry_state, start, end).agg(F.count(F.lit(1)).alias("cnt"))


def iteration_time(attempts, every="1 day"):
    """Seconds between the first and last attempt of each pass."""
    return (
        attempts.groupBy(F.window("ts", every).alias("w"))
        .agg((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))).alias("us"))
        .select(
            F.unix_timestamp("w.start").alias("iteration_start"),
            (F.col("us") / F.lit(1_000_000.0)).alias("seconds"),
        )
    )


# ------------------------------------------------------------ connections, gossip


def connected_peers(halves, as_of):
    """Peers whose latest half up to `as_of` is an open."""
    seen = halves.filter(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    last = seen.groupBy("peer_id").agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"))
    return last.filter(F.col("kind") == "open").agg(F.count(F.lit(1)).alias("cnt"))


def peers_per_topic(messages):
    """Distinct senders per topic; duplicates are removed before topics meet."""
    return (
        messages.select("topic", "sender")
        .distinct()
        .groupBy("topic")
        .agg(F.count("sender").alias("peers"))
    )


def sender_sketches(messages, every="1 hour", precision=12):
    """Mergeable sketches of the senders per window and topic (2^precision registers at most).

    Also the streaming form: give `messages` a watermark first.  A sketch is a bounded value however many senders it
    has seen; sketches of any windows and topics can be united afterwards.
    """
    return (
        messages.groupBy(F.window("arrival_time", every).alias("w"), "topic")
        .agg(F.hll_sketch_agg("sender", precision).alias("senders"))
        .select(F.col("w.start").alias("window_start"), "topic", "senders")
    )


def united_senders(sketches, *keys):
    """Estimated distinct senders per `keys` of stored sketches; columns or expressions, none for one total."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("senders")).alias("peers"))


def messages_per_topic(messages, tick=D.METRIC_TICK):
    """Messages per topic and tick, with the per-minute rate.

    Also the streaming form: give `messages` a watermark first.
    """
    minutes = F.timestamp_diff("SECOND", F.col("w.start"), F.col("w.end")) / F.lit(60.0)
    return (
        messages.groupBy(F.window("arrival_time", tick).alias("w"), "topic")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(
            F.unix_timestamp("w.start").alias("window_start"),
            "topic",
            "cnt",
            (F.col("cnt") / minutes).alias("per_minute"),
        )
    )


def newest_rates(rates):
    """Rates per second, of `messages_per_topic` or `messages_total`, in the newest tick that has messages."""
    newest = rates.agg(F.max("window_start")).scalar()
    return rates.filter(F.col("window_start") == newest).withColumn("per_second", F.col("per_minute") / F.lit(60.0))


def messages_total(messages, tick=D.METRIC_TICK):
    return (
        messages_per_topic(messages, tick)
        .groupBy("window_start")
        .agg(F.sum("cnt").alias("cnt"), F.sum("per_minute").alias("per_minute"))
    )


def head_slot(status_events):
    """The whole status row with the highest head slot; ties keep the earliest."""
    rows = status_events.withColumn(
        "rank", F.struct("head_slot", (-F.unix_micros("ts")).alias("t"), (-F.col("seq")).alias("s"))
    )
    best = rows.agg(F.max_by(F.struct(*status_events.columns), "rank").alias("best"))
    return best.filter(F.col("best").isNotNull()).select("best.*")


def supported_protocols(peers, network=None):
    return (
        _network(peers, network)
        .select(F.explode("sup_protocols").alias("protocol"))
        .groupBy("protocol")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
