"""Export and report queries.

`peer_info.peer_id` and `ips.ip` are keys, so the number of distinct peers of a
group is a sum of per-address counts: peers are counted per address first, and
only then joined and grouped.
"""

from pyspark.sql import functions as F

from peerlens.operators.predicates import listed_peers

LOCATION_COLUMNS = [
    "peer_id", "network", "ip", "port", "user_agent", "client_name", "client_version",
    "country", "city", "lat", "lon", "isp", "org", "as_raw", "asname", "hosting",
]
IP_COLUMNS = [
    "ip", "country", "country_code", "city", "region_name", "lat", "lon", "isp", "org",
    "as_raw", "asname", "hosting", "proxy", "mobile",
]


def _geo(ips):
    """Geolocation with coordinates widened once, so both read the same digits."""
    return ips.withColumn("lat", F.col("lat").cast("double")).withColumn(
        "lon", F.col("lon").cast("double")
    )


def _located(peers, ips, network, since, until):
    listed = listed_peers(peers, network, since, until)
    return listed.join(_geo(ips), "ip")


def peer_locations(peers, ips, network=None, since=None, until=None, ordered=True):
    rows = _located(peers, ips, network, since, until).select(LOCATION_COLUMNS)
    # The peer breaks ties, so that one city's rows can be sorted by many tasks.
    return rows.orderBy("network", "country", "city", "peer_id") if ordered else rows


def all_ips(peers, ips, network=None, since=None, until=None, ordered=True):
    used = listed_peers(peers, network, since, until).select("ip").distinct()
    rows = _geo(ips).join(used, "ip", "left_semi").select(IP_COLUMNS)
    return rows.orderBy("country", "city", "ip") if ordered else rows


def counted_addresses(peers, ips, network=None, since=None, until=None, by=()):
    """Located addresses with their number of listed peers `n`, also per `by` columns."""
    listed = listed_peers(peers, network, since, until)
    return listed.groupBy(*by, "ip").agg(F.count(F.lit(1)).alias("n")).join(_geo(ips), "ip")


def _mean(column):
    """Mean over peers of a per-address value, to four decimals."""
    weighted = F.sum(F.col(column) * F.col("n")) / F.sum("n")
    return F.round(weighted.cast("decimal(20,10)"), 4).cast("double")


def _hosted():
    return F.sum(F.when(F.col("hosting"), F.col("n")).otherwise(0)).alias("hosted_nodes")


def _largest_first(df, by, keys):
    """By count; the group's keys settle ties, so every run gives the same order."""
    return df.orderBy(*by, F.desc("peer_count"), *keys)


def countries_of(counted, by=()):
    rows = counted.groupBy(*by, "country", "country_code").agg(
        F.sum("n").alias("peer_count"),
        F.count_distinct("asname").alias("unique_asns"),
        _hosted(),
        _mean("lat").alias("avg_lat"),
        _mean("lon").alias("avg_lon"),
    )
    return _largest_first(rows, by, ("country", "country_code"))


def cities_of(counted, by=()):
    rows = (
        counted.filter(F.col("city") != "")
        .groupBy(*by, "city", "country", "country_code", "lat", "lon")
        .agg(F.sum("n").alias("peer_count"))
        .filter(F.col("peer_count") >= 2)
        .select(*by, "city", "country", "country_code", "peer_count", "lat", "lon")
    )
    return _largest_first(rows, by, ("city", "country", "country_code", "lat", "lon"))


def providers_of(counted, by=()):
    rows = (
        counted.filter(F.col("org") != "")
        .groupBy(*by, "org", "hosting")
        .agg(F.sum("n").alias("peer_count"), F.count_distinct("country").alias("countries"))
        .filter(F.col("peer_count") >= 2)
        .select(*by, F.col("org").alias("provider"), "peer_count", "countries", "hosting")
    )
    return _largest_first(rows, by, ("provider", "hosting"))


def systems_of(counted, by=()):
    rows = (
        counted.filter(F.col("asname") != "")
        .groupBy(*by, "asname", "as_raw", "org")
        .agg(
            F.sum("n").alias("peer_count"),
            F.count_distinct("country").alias("countries"),
            _hosted(),
        )
    )
    return _largest_first(rows, by, ("asname", "as_raw", "org"))


def country_stats(peers, ips, network=None, since=None, until=None):
    return countries_of(counted_addresses(peers, ips, network, since, until))


def city_stats(peers, ips, network=None, since=None, until=None):
    return cities_of(counted_addresses(peers, ips, network, since, until))


def hosting_stats(peers, ips, network=None, since=None, until=None):
    return providers_of(counted_addresses(peers, ips, network, since, until))


def as_stats(peers, ips, network=None, since=None, until=None):
    return systems_of(counted_addresses(peers, ips, network, since, until))


def client_stats(peers, network=None, since=None, until=None, by=()):
    """Client configurations with their share (of each `by` group); NULL groups are kept."""
    counted = (
        listed_peers(peers, network, since, until)
        .groupBy(*by, "client_name", "client_version", "client_os", "client_arch")
        .agg(F.count(F.lit(1)).alias("peer_count"))
    )
    if by:
        totals = counted.groupBy(*by).agg(F.sum("peer_count").alias("total"))
        counted = counted.join(totals, list(by))
        total = F.col("total")
    else:
        # A scalar subquery over the grouped rows, not a global window.
        total = counted.select(F.sum("peer_count")).scalar()
    share = F.round((100 * F.col("peer_count")).cast("decimal(24,0)") / total, 2)
    rows = counted.withColumn("percentage", share.cast("double"))
    return _largest_first(
        rows.drop("total"), by, ("client_name", "client_version", "client_os", "client_arch")
    )


# ------------------------------------------------------------ top-k documents


def country_top(peers, ips, k=None, network=None):
    """Peers per country; all of them unless `k` is given."""
    rows = country_stats(peers, ips, network).select("country", "country_code", "peer_count")
    rows = rows.orderBy(F.desc("peer_count"), "country", "country_code")
    return rows if k is None else rows.limit(k)


def city_top50(peers, ips, k=50, network=None):
    return (
        counted_addresses(peers, ips, network)
        .groupBy("country", "city")
        .agg(F.sum("n").alias("peer_count"))
        .orderBy(F.desc("peer_count"), "country", "city")
        .limit(k)
    )


def hosting_top20(peers, ips, k=20, network=None):
    return (
        counted_addresses(peers, ips, network)
        .filter("hosting")
        .groupBy("org", "hosting")
        .agg(F.sum("n").alias("peer_count"))
        .orderBy(F.desc("peer_count"), "org")
        .limit(k)
    )


# ------------------------------------------------------------ other shapes


def network_locations_outer(peers, ips, network):
    """Every listed peer of a network, located or not; newest activity first."""
    columns = [
        "peer_id", "ip", "port", "user_agent", "client_name", "client_version", "country",
        "country_code", "city", "lat", "lon", "isp", "org", "asname", "hosting",
    ]
    rows = listed_peers(peers, network).join(_geo(ips), "ip", "left")
    return rows.orderBy(F.col("last_activity").desc_nulls_first(), "peer_id").select(columns)


def peer_locations_small(peers, ips, network=None, columns=10):
    """The seven- and ten-column variants of the location export."""
    chosen = {
        7: ["peer_id", "ip", "port", "country", "city", "lat", "lon"],
        10: ["peer_id", "ip", "port", "country", "city", "lat", "lon", "isp", "org", "hosting"],
    }[columns]
    rows = peer_locations(peers, ips, network, ordered=False).select(chosen)
    return rows.orderBy("country", "city", "peer_id") if columns == 10 else rows


def networks(peers):
    """Networks with a listed peer, sorted."""
    return listed_peers(peers).select("network").distinct().orderBy("network")
