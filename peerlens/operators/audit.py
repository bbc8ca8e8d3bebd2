"""Data-quality queries."""

from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.operators.predicates import listed_peers


def _per_network_ip(peers):
    return listed_peers(peers).groupBy("network", "ip").agg(F.count(F.lit(1)).alias("n"))


def peers_by_network(peers):
    """Listed peers and distinct addresses per network, and in total (`network` NULL)."""
    pairs = _per_network_ip(peers)
    return pairs.rollup("network").agg(
        F.sum("n").alias("peers"), F.count_distinct("ip").alias("unique_ips")
    )


def networks_all_counts(peers):
    return peers.groupBy("network").agg(F.count(F.lit(1)).alias("peers"))


def client_homes(client_name):
    """Networks whose client lists have the name (a name may be in several), NULL for an unlisted name."""
    homes = {}
    for network, words in D.CLIENT_WORDS.items():
        for name, _ in words:
            homes.setdefault(name, []).append(network)
    pairs = [x for name, found in homes.items() for x in (F.lit(name), F.array(*map(F.lit, found)))]
    return F.try_element_at(F.create_map(*pairs), client_name)


def contamination(peers):
    """Peers whose client belongs to another network, deprecated ones included."""
    return (
        peers.filter(~F.array_contains(client_homes(F.col("client_name")), F.col("network")))
        .groupBy("network", "client_name")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def ip_overlap(peers):
    """Addresses that two networks share.

    The networks of an address form a set of at most five, so its pairs are
    listed inside the row.
    """
    sets = listed_peers(peers).groupBy("ip").agg(
        F.sort_array(F.collect_set("network")).alias("nets")
    )
    pairs = F.flatten(
        F.transform(
            "nets",
            lambda a: F.transform(
                F.filter("nets", lambda b: a < b),
                lambda b: F.struct(a.alias("network_a"), b.alias("network_b")),
            ),
        )
    )
    return (
        sets.filter(F.size("nets") > 1)
        .select(F.explode(pairs).alias("p"))
        .groupBy("p.network_a", "p.network_b")
        .agg(F.count(F.lit(1)).alias("shared_ips"))
    )


def unique_ips(peers):
    return _per_network_ip(peers).groupBy("network").agg(F.count("ip").alias("unique_ips"))


def ip_overlap_share(peers):
    """Overlap as a percentage of either side."""
    sizes = unique_ips(peers)
    a = sizes.select(F.col("network").alias("network_a"), F.col("unique_ips").alias("ips_a"))
    b = sizes.select(F.col("network").alias("network_b"), F.col("unique_ips").alias("ips_b"))

    def percent(side):
        return F.round(F.lit(100.0) * F.col("shared_ips") / F.col(side), 2)

    return (
        ip_overlap(peers)
        .join(a, "network_a")
        .join(b, "network_b")
        .select(
            "network_a", "network_b", "shared_ips",
            percent("ips_a").alias("pct_a"), percent("ips_b").alias("pct_b"),
        )
    )


def geo_coverage(peers, ips):
    """Located share of each network's addresses."""
    located = ips.select("ip", F.lit(True).alias("located"))
    return (
        _per_network_ip(peers)
        .join(located, "ip", "left")
        .groupBy("network")
        .agg(F.count("ip").alias("unique_ips"), F.count("located").alias("located_ips"))
        .withColumn("coverage", F.round(F.lit(100.0) * F.col("located_ips") / F.col("unique_ips"), 1))
    )


def activity_range(peers, ips, since, until, report):
    """Any export restricted to a range of last activity."""
    return report(peers, ips, since=since, until=until)
