"""Lookups and filters over the tables."""

from pyspark.sql import functions as F

from peerlens.functions import address


def full_host_info(peers, peer_id):
    """One peer, epochs as timestamps, latency as nanoseconds."""
    return (
        peers.filter(F.col("peer_id") == peer_id)
        .withColumn("last_activity", F.timestamp_seconds("last_activity"))
        .withColumn("last_conn_attempt", F.timestamp_seconds("last_conn_attempt"))
        .withColumn("latency_ns", F.col("latency").cast("long") * 1_000_000)
        .drop("latency")
    )


def persistable_peer(peers, peer_id):
    return peers.filter(F.col("peer_id") == peer_id).select("peer_id", "network", "multi_addrs")


def peer_exists(keys, peers, key="peer_id"):
    """Each asked key with whether the peer is known."""
    known = peers.select(F.col("peer_id").alias(key), F.lit(True).alias("known"))
    return keys.join(known, key, "left").select(
        key, F.coalesce("known", F.lit(False)).alias("peer_exists")
    )


def connectable_peers(peers, network=None):
    """Listed peers with an id, keeping only well-formed addresses."""
    rows = peers.filter(~F.col("deprecated") & (F.col("peer_id") != ""))
    if network is not None:
        rows = rows.filter(F.col("network") == network)
    return rows.select(
        "peer_id", "network", F.filter("multi_addrs", address.is_multiaddr).alias("multi_addrs")
    )


def ip_info(ips, ip):
    return ips.filter(F.col("ip") == ip)


def expired_ips(ips, as_of):
    return ips.filter(F.col("expiration_time") < F.lit(as_of).cast("timestamp")).select("ip")


def ip_record_status(keys, ips, as_of):
    """Each asked address with whether a cache row exists and has expired."""
    cached = ips.select("ip", "expiration_time")
    late = F.col("expiration_time") < F.lit(as_of).cast("timestamp")
    return keys.join(cached, "ip", "left").select(
        "ip",
        F.col("expiration_time").isNotNull().alias("record_exists"),
        F.coalesce(late, F.lit(False)).alias("record_expired"),
    )


def ips_to_locate(peers, ips, as_of, batch=None):
    """All public addresses without a live cache row; `batch` asks for that many, the first in address order."""
    wanted = peers.filter(address.is_public_ip(F.col("ip"))).select("ip").distinct()
    live = ips.filter(F.col("expiration_time") >= F.lit(as_of).cast("timestamp")).select("ip")
    missing = wanted.join(live, "ip", "left_anti")
    return missing if batch is None else missing.orderBy("ip").limit(batch)


def discovered_valid_nodes(discoveries):
    """Discovered nodes one can dial: with address and TCP port."""
    return discoveries.filter((F.col("node_tcp") != 0) & F.col("node_ip").isNotNull())


def discovered_dedup(discoveries):
    """Each peer once, as first seen."""
    columns = [c for c in discoveries.columns if c != "peer_id"]
    return (
        discoveries.groupBy("peer_id")
        .agg(F.min_by(F.struct(*columns), F.struct("ts", "seq")).alias("r"))
        .select("peer_id", "r.*")
    )


def public_discoveries(hosts):
    """Every discovery, marked whether its address is to be located."""
    return hosts.withColumn("is_public", address.is_public_ip(F.col("ip")))
