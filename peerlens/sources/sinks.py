"""Result writers: CSV, JSON and GeoJSON, and the per-network export run."""

import os

from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.operators import reports
from peerlens.session import cut

# File names of the exports.
EXPORTS = {
    "peers": ("peer_locations", reports.peer_locations),
    "ips": ("all_ips", reports.all_ips),
    "country": ("peer_count_by_country", reports.country_stats),
    "city": ("peer_count_by_city", reports.city_stats),
    "hosting": ("hosting_provider_distribution", reports.hosting_stats),
    "as": ("peer_count_by_as", reports.as_stats),
    "clients": ("client_distribution", None),
}
COMBINED_PREFIX = "all_networks_"


def network_file_prefix(network):
    """Column: file-name prefix of a network."""
    return F.concat(F.translate(F.lower(network), " ", "_"), F.lit("_"))


def prefix_of(network):
    if network is None:
        return COMBINED_PREFIX
    return network.lower().replace(" ", "_") + "_"


def write_csv(df, directory, prefix, name, single_file=False):
    """CSV with header under `<directory>/<prefix><name>.csv`.

    Writers stay parallel and the ordered parts carry increasing numbers;
    `single_file=True` is for results known to be small.
    """
    path = os.path.join(directory, f"{prefix}{name}.csv")
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_all(peers, ips, directory, networks=None, exports="all", single_file=False):
    """Run exports for each network of `networks`, or combined when None.

    Returns the paths by (network, export).
    """
    chosen = EXPORTS if exports == "all" else {exports: EXPORTS[exports]}
    paths = {}
    for network in networks if networks is not None else [None]:
        for key, (name, report) in chosen.items():
            if report is None:
                df = reports.client_stats(peers, network)
            else:
                df = report(peers, ips, network)
            paths[network, key] = write_csv(df, directory, prefix_of(network), name, single_file)
    return paths


#: Row order of each export within a file; `-` is descending.
ORDERS = {
    "peers": "country city peer_id",
    "ips": "country city ip",
    "country": "-peer_count country country_code",
    "city": "-peer_count city country country_code lat lon",
    "hosting": "-peer_count provider hosting",
    "as": "-peer_count asname as_raw org",
    "clients": "-peer_count client_name client_version client_os client_arch",
}


def _order(key):
    return [F.desc(c[1:]) if c[0] == "-" else F.col(c) for c in ORDERS[key].split()]


def export_networks(peers, ips, directory):
    """All exports of all networks at once: one job per export, not per network.

    The network is one more group key, and rows go to one folder per file name
    (`file=<network prefix><export>.csv`).  The peers are counted per network
    and address once; four of the reports start from that count.
    """
    by = ["network"]
    counted = cut(reports.counted_addresses(peers, ips, by=by), "counted")
    addresses = counted.select(*by, *reports.IP_COLUMNS)
    results = {
        "peers": reports.peer_locations(peers, ips),
        "ips": addresses,
        "country": reports.countries_of(counted, by),
        "city": reports.cities_of(counted, by),
        "hosting": reports.providers_of(counted, by),
        "as": reports.systems_of(counted, by),
        "clients": reports.client_stats(peers, by=by),
    }
    paths = {}
    for key, df in results.items():
        name = EXPORTS[key][0]
        file = F.concat(network_file_prefix(F.col("network")), F.lit(f"{name}.csv"))
        paths[key] = os.path.join(directory, name)
        # Ordered by file first: the writer then needs no sort of its own, and rows keep the report's order.
        out = df.withColumn("file", file).orderBy("file", *_order(key))
        if key != "peers":  # that export shows the network as a column
            out = out.drop("network")
        out.write.mode("overwrite").option("header", True).partitionBy("file").csv(paths[key])
    return paths


# ------------------------------------------------------------ JSON


def export_json(df):
    """One JSON object text per row (JSON lines)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def geojson_feature():
    """A Point feature with its six properties."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(
                F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")
            ).alias("geometry"),
            F.struct("peer_id", "ip", "country", "city", "isp", "hosting").alias("properties"),
        ),
        {"ignoreNullFields": "false"},
    )


def export_geojson(peers, ips, network=None):
    """One Feature text per row; keyed by peer."""
    rows = reports.peer_locations(peers, ips, network, ordered=False)
    return rows.select("peer_id", geojson_feature().alias("feature"))


def as_document(elements, key, text, opening, closing):
    """Lines that, read in order, are one JSON document around `elements`.

    Works by sorting lines, so the document is never inside one row: the line
    with the greatest key is the one without a comma.  `key` must be unique.
    """
    last = elements.select(F.max(key)).scalar()
    body = elements.select(
        F.lit(1).alias("part"),
        F.col(key).alias("key"),
        F.concat(F.col(text), F.when(F.col(key) == last, "").otherwise(",")).alias("value"),
    )
    edge = elements.sparkSession.range(2).select(
        F.when(F.col("id") == 0, 0).otherwise(2).alias("part"),
        F.lit(None).cast(elements.schema[key].dataType).alias("key"),
        F.when(F.col("id") == 0, opening).otherwise(closing).alias("value"),
    )
    return body.unionByName(edge).orderBy("part", "key").select("value")


def geojson_document(features):
    return as_document(
        features, "peer_id", "feature", '{"type":"FeatureCollection","features":[', "]}"
    )


def json_array_document(df, key):
    """The rows as one JSON array, in key order."""
    lines = df.select(
        F.col(key), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")
    )
    return as_document(lines, key, "j", "[", "]")


def write_lines(df, path):
    """Text parts in row order; concatenated in name order they are the document."""
    df.write.mode("overwrite").text(path)
    return path


# ------------------------------------------------------------ published events


def _empty(column, kind="string"):
    return F.coalesce(F.col(column), F.lit("" if kind == "string" else 0).cast(kind))


def timed_attestations(attestations, peers):
    """Attestations with what is known of their sender; unknown senders get empty fields.

    The distinct senders meet the peer table first: stored in buckets by peer (`tables.bucketed`), it is not moved, and
    a sender with very many messages is one row there.  What was found is joined back; adaptive execution broadcasts
    it if it is short, and splits a busy sender otherwise.  A streaming side is joined with the table directly.
    """
    known = peers.select(
        F.col("peer_id").alias("sender"), "ip", "port", "user_agent",
        (F.col("latency").cast("long") * 1_000_000).alias("latency"),
        "sup_protocols", "protocol_version",
    )
    if not attestations.isStreaming:
        known = senders_found(attestations, known)
    joined = attestations.join(known, "sender", "left")
    return joined.select(
        "msg_id",
        "seq",
        F.struct("slot", "subnet").alias("attestation"),
        F.struct(
            F.date_format("arrival_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("arrived_at"),
            F.col("msg_id").alias("peer_msg_id"),
            "subnet",
            F.round(F.col("time_in_slot") * 1_000_000_000).cast("long").alias("time_in_slot"),
        ).alias("attestation_extra_data"),
        F.struct(
            F.col("sender").alias("id"),
            _empty("ip").alias("ip"),
            _empty("port", "int").alias("port"),
            _empty("user_agent").alias("user_agent"),
            _empty("latency", "long").alias("latency"),
            F.coalesce("sup_protocols", F.array().cast("array<string>")).alias("protocols"),
            _empty("protocol_version").alias("protocol_version"),
        ).alias("peer_info"),
    )


def senders_found(attestations, known):
    return attestations.select("sender").distinct().join(known, "sender")


def attestation_event_json(timed):
    """The two published events of every attestation: raw and timed."""
    raw = F.to_json(F.struct("attestation"))
    full = F.to_json(F.struct("attestation", "attestation_extra_data", "peer_info"))
    events = F.array(
        F.struct(F.lit(D.EVENT_ATTESTATION).alias("topic"), raw.alias("value")),
        F.struct(F.lit(D.EVENT_TIMED_ATTESTATION).alias("topic"), full.alias("value")),
    )
    return timed.select(F.col("msg_id").alias("key"), F.explode(events).alias("e")).select(
        "key", "e.*"
    )
