"""Every operator as a query over the test tables.

Each query is `f(spark, directory) -> DataFrame`.  `flat` only changes how a
result is spelled: arrays become joined text and timestamps become text, so
that two engines can be compared value by value.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens import domains as D
from peerlens.functions import address, errors, forks, gossip, user_agent
from peerlens.operators import (
    audit, connections, distributions, folds, graph, lookups, normalise, passes, reports, retry,
)
from peerlens.plans import handlers
from peerlens.plans.policy import DEFAULT_POLICY, RetryPolicy
from peerlens.plans.registry import Tables, default_registry
from peerlens.schemas import PEER_INFO, TABLES
from peerlens.session import run_dir
from peerlens.sources import bridge, geo, sinks, tables
from peerlens.streaming import jobs

NET = D.ETHEREUM
AS_OF, EVENTS_AS_OF = bridge.AS_OF, bridge.EVENTS_AS_OF
LAST_DAY = "2024-01-30 00:00:00"
SHOWN_PEER = "Customer#000000042"
SHOWN_IP = "52.3.0.5"
# A policy under which the thirty days of events contain deprecations.
STRICT = RetryPolicy(deprecate_after=2 * 86400)


def flat(df):
    out = []
    for f in df.schema.fields:
        c, t = F.col(f.name), f.dataType
        if isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(t, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(out)


class Inputs:
    """The bridged tables of one directory, built on demand."""

    def __init__(self, spark, directory):
        self.spark, self.dir = spark, directory

    @property
    def peers(self):
        return bridge.peer_info(self.spark, self.dir)

    @property
    def peers_listed(self):
        """Peers without the activity columns (and without their join)."""
        return bridge.peer_info(self.spark, self.dir, activity=False)

    @property
    def ips(self):
        return bridge.ips(self.spark, self.dir)

    @property
    def events(self):
        return bridge.read_events(self.spark, self.dir)

    @property
    def halves(self):
        return bridge.conn_halves(self.events)

    @property
    def dials(self):
        return bridge.raw_dials(self.events)

    @property
    def attempts(self):
        return normalise.normalise_attempts(self.dials)

    @property
    def discoveries(self):
        return bridge.discoveries(self.events)

    @property
    def hosts(self):
        return normalise.normalise_peers(self.discoveries)

    @property
    def connections(self):
        return bridge.raw_connections(self.events)

    @property
    def messages(self):
        return bridge.messages(self.events)

    @property
    def attestations(self):
        return normalise.gossip_to_rows(self.messages, "attestation", bridge.SELF_ID)

    @property
    def blocks(self):
        return normalise.gossip_to_rows(self.messages, "block", bridge.SELF_ID)

    @property
    def raw_records(self):
        return bridge.raw_records(self.spark, self.dir)

    @property
    def records(self):
        return normalise.normalise_records(self.raw_records)

    @property
    def eth_nodes(self):
        return folds.fold_eth_nodes(self.records)

    @property
    def probes(self):
        return bridge.probes(self.spark, self.dir)

    def identified(self):
        return normalise.identify_events(self.connections)

    def live_attempts(self, policy=DEFAULT_POLICY):
        lives = retry.peer_lives(self.attempts, self.hosts, policy)
        return retry.live_attempts(self.attempts, lives)

    def conn_events(self):
        return connections.pair_conn_events(self.halves)

    def retry_state(self, policy=DEFAULT_POLICY):
        return retry.peer_retry_state(self.attempts, self.hosts, policy, EVENTS_AS_OF)

    def peer_state(self, policy=DEFAULT_POLICY):
        _, answers, _, _ = self.identified()
        return folds.fold_peer_state(
            self.hosts, answers, self.live_attempts(policy), self.conn_events()
        )

    def table(self, name):
        """Rows of one of the eight tables."""
        if name == "peer_info":
            return self.peers
        if name == "ips":
            return self.ips
        if name == "conn_events":
            return self.conn_events()
        if name == "active_peers":
            return folds.active_peers_snapshot(self.peers, AS_OF)
        if name == "eth_nodes":
            return self.eth_nodes
        if name == "eth_status":
            return folds.fold_chain_answers(normalise.chain_answers(self.connections))
        if name == "eth_attestations":
            return folds.insert_attestations(self.attestations)
        return folds.insert_blocks(self.blocks)


REGISTRY = {}


def query(name):
    def add(build):
        def run(spark, directory):
            # The test tables carry zoneless UTC times.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return flat(build(Inputs(spark, directory)))

        run.__name__ = name
        REGISTRY[name] = run
        return build

    return add


def simple(name, build):
    query(name)(build)


# ------------------------------------------------------------ scans, sinks


def _scan(name):
    def build(b):
        folder = run_dir(b.spark, "tables")
        tables.save(b.table(name), folder, name)
        return tables.load(b.spark, folder, name)

    return build


for _name in TABLES:
    simple(f"scan_{_name}", _scan(_name))

simple(
    "ingest_ip_api",
    lambda b: geo.ingest_ip_api(bridge.geo_answer_json(b.spark, b.dir), AS_OF),
)
simple("located_ips", lambda b: geo.located_ips(b.ips))


@query("export_csv")
def _export_csv(b):
    folder = run_dir(b.spark, "csv")
    path = sinks.write_csv(
        reports.country_stats(b.peers_listed, b.ips), folder, sinks.prefix_of(None), "by_country"
    )
    schema = (
        "country string, country_code string, peer_count long, unique_asns long, "
        "hosted_nodes long, avg_lat double, avg_lon double"
    )
    rows = b.spark.read.option("header", True).schema(schema).csv(path)
    return rows.withColumn("country", F.coalesce("country", F.lit("")))


simple(
    "network_file_prefix",
    lambda b: b.peers_listed.select(
        "network", sinks.network_file_prefix(F.col("network")).alias("prefix")
    ).distinct(),
)
simple(
    "export_json",
    lambda b: sinks.export_json(reports.peer_locations_small(b.peers_listed, b.ips, columns=10)),
)
simple("export_geojson", lambda b: sinks.export_geojson(b.peers_listed, b.ips))
simple(
    "geojson_document",
    lambda b: sinks.geojson_document(sinks.export_geojson(b.peers_listed, b.ips)),
)
simple(
    "json_array_document",
    lambda b: sinks.json_array_document(
        reports.peer_locations_small(b.peers_listed, b.ips, columns=10), "peer_id"
    ),
)
simple(
    "attestation_event_json",
    lambda b: sinks.attestation_event_json(
        sinks.timed_attestations(b.attestations, b.peers_listed)
    ),
)


#: Seconds without a dial that end a pass: the test log is thin.
PASS_GAP = 2700


def all_gauges(b, network=None, events=None):
    """Every gauge at a moment at which none is empty: the stored tables at theirs, what the events give at theirs.

    `events` is the part of the event log that connections, messages and status are taken from.
    """
    registry = default_registry(PASS_GAP)
    events = b.events if events is None else events
    stored = Tables(peers=b.peers, ips=b.ips, eth_nodes=b.eth_nodes)
    moving = Tables(
        retry_state=retry.queued(b.retry_state()), attempts=b.attempts, halves=bridge.conn_halves(events),
        messages=bridge.messages(events), status=normalise.identify_events(bridge.raw_connections(events))[2],
    )
    return registry.snapshot(stored, AS_OF, network).unionByName(registry.snapshot(moving, EVENTS_AS_OF, network))


simple("metrics_snapshot", lambda b: all_gauges(b, NET))
simple("metric_registry", all_gauges)


# ------------------------------------------------------------ scalar functions

def _agents(build):
    """A user-agent function over every connection."""
    return lambda b: b.connections.select("seq", "network", "user_agent", build())


UA = ("user_agent", "network")
simple("ua_client_name", _agents(lambda: user_agent.ua_client_name(*UA).alias("client_name")))
simple("ua_client_version", _agents(lambda: user_agent.ua_client_version(*UA).alias("client_version")))
simple("ua_version_lotus", _agents(lambda: user_agent.ua_version_lotus(UA[0]).alias("client_version")))
simple("ua_client_os", _agents(lambda: user_agent.ua_client_os(UA[0]).alias("client_os")))
simple("ua_client_arch", _agents(lambda: user_agent.ua_client_arch(UA[0]).alias("client_arch")))
simple(
    "parse_client",
    lambda b: b.connections.select("seq", user_agent.parse_client(*UA).alias("c")).select("seq", "c.*"),
)
simple("is_identified", _agents(lambda: user_agent.is_identified().alias("identified")))
simple(
    "latency_ms",
    lambda b: b.connections.select("seq", user_agent.latency_ms("latency_ns").alias("ms")),
)
simple(
    "classify_dial_error",
    lambda b: b.dials.select("seq", errors.classify_dial_error(F.col("message")).alias("error")),
)
simple(
    "delay_class",
    lambda b: b.peers_listed.select(
        "peer_id", "last_error", errors.delay_class(F.col("last_error")).alias("delay_class")
    ),
)


def _each_address(b, build):
    rows = b.discoveries.select("seq", F.explode("multi_addrs").alias("address"))
    return rows.select("seq", "address", build(F.col("address")))


simple("maddr_ip", lambda b: _each_address(b, lambda a: address.maddr_ip(a).alias("ip")))
simple("maddr_port", lambda b: _each_address(b, lambda a: address.maddr_port(a).alias("port")))
simple("first_public_addr", lambda b: b.hosts.select("seq", "ip", "port"))
simple(
    "direction_name",
    lambda b: b.halves.filter("kind = 'open'").select(
        "seq", errors.direction_name(F.col("direction")).alias("direction")
    ),
)

def _announced(b, *columns):
    """Columns worked out from the addresses of node records, of all classes and partly malformed."""
    return b.raw_records.select("ord", "ip", *columns)


simple("is_public_ip", lambda b: _announced(b, address.is_public_ip(F.col("ip")).alias("is_public")))
simple("is_valid_ip", lambda b: _announced(b, address.is_valid_ip(F.col("ip")).alias("valid")))
simple(
    "compose_maddr",
    lambda b: b.peers_listed.select(
        "peer_id", address.compose_maddr(F.col("ip"), F.col("port")).alias("address")
    ),
)


def _forks(b, *columns):
    """Columns worked out from the fork digests of node records."""
    return b.records.filter("fork_digest IS NOT NULL").select("ord", *columns)


simple(
    "compose_topic",
    lambda b: _forks(b, gossip.compose_topic(F.col("fork_digest"), F.lit(D.BLOCK_TOPIC)).alias("topic")),
)
simple(
    "compose_attnets_topic",
    lambda b: _forks(b, gossip.compose_attnets_topic(F.col("fork_digest"), F.col("attnets_number")).alias("topic")),
)
simple("topic_pretty", lambda b: b.messages.select("seq", gossip.topic_pretty(F.col("topic")).alias("pretty")))
simple("topic_subnet", lambda b: b.messages.select("seq", gossip.topic_subnet(F.col("topic")).alias("subnet")))


def _fork_texts(b):
    """Fork texts as they arrive: in node records (whole or wrong fields too) and in topics."""
    records = b.raw_records.select(F.col("ord").alias("seq"), F.explode(F.array("eth2", F.substring("eth2", 1, 10))).alias("text"))
    return records.unionByName(b.messages.select("seq", F.element_at(F.split("topic", "/"), 3).alias("text")))


simple(
    "valid_fork_digest",
    lambda b: _fork_texts(b).withColumn("digest", forks.valid_fork_digest(F.col("text"))),
)
simple(
    "genesis_for_digest",
    lambda b: _forks(
        b,
        "fork_digest",
        forks.genesis_for_digest(F.col("fork_digest")).alias("genesis"),
        forks.genesis_defaulted(F.col("fork_digest")).alias("genesis_defaulted"),
    ),
)
simple(
    "time_in_slot",
    lambda b: b.messages.select(
        "seq",
        gossip.time_in_slot(F.col("arrival_time"), F.col("slot"), F.lit(D.MAINNET_GENESIS)).alias(
            "time_in_slot"
        ),
    ),
)
simple("message_id", lambda b: b.messages.select("seq", gossip.message_id(F.col("payload")).alias("msg_id")))
simple(
    "attnets_count",
    lambda b: b.raw_records.select("ord", forks.attnets_count(F.col("attnets")).alias("attnets_number")),
)
simple(
    "eth2_data_fields",
    lambda b: b.raw_records.select("ord", forks.eth2_data_fields(F.col("eth2")).alias("f")).select(
        "ord", F.col("f.fork_digest"), F.col("f.next_fork_version"), F.col("f.next_fork_epoch"),
        F.col("f.exists").alias("eth2_exists"), F.col("f.error"),
    ),
)
simple(
    "enr_fork_match",
    lambda b: b.records.filter(
        forks.enr_fork_match(F.col("fork_digest"), bridge.DIGESTS[1])
    ).select("ord", "node_id", "fork_digest"),
)
simple(
    "hex_normalise",
    lambda b: b.raw_records.select("ord", forks.hex_normalise(F.col("eth2"), "eth2").alias("h")).select(
        "ord", F.col("h.value"), F.col("h.error")
    ),
)

# ------------------------------------------------------------ normalisation jobs

simple("normalise_peers", lambda b: b.hosts.select("peer_id", "ts", "seq", "network", "multi_addrs", "ip", "port"))
simple("normalise_attempts", lambda b: b.attempts)
simple("conn_attempt_from_dial", lambda b: normalise.conn_attempt_from_dial(b.dials).drop("delay_class"))


simple("normalise_gossip", lambda b: normalise.gossip_log(b.messages, bridge.SELF_ID).drop("kind"))
simple("gossip_to_rows", lambda b: b.attestations)
simple("normalise_records", lambda b: b.records)


@query("topic_handlers")
def _topic_handlers(b):
    rejected = normalise.rejected_gossip(b.messages, bridge.SELF_ID)
    return rejected.select("seq", "topic", "reason")


@query("identify_events")
def _identify_events(b):
    """A row per event of any kind, from one pass over the connections."""

    def event(table, column, detail):
        tagged = F.struct(F.lit(table).alias("table"), F.col(detail).cast("string").alias("detail"))
        return F.when(F.col(column).isNotNull(), tagged)

    events = F.array_compact(F.array(
        event("host", "host", "host.ip"), event("peer", "p", "p.client_version"), event("status", "s", "s.head_slot"),
        event("metadata", "m", "m.attnets"),
    ))
    rows = normalise.identify_log(b.connections).select("peer_id", "seq", F.explode(events).alias("e"))
    return rows.select("e.table", "peer_id", "seq", "e.detail")


# ------------------------------------------------------------ folds

simple("fold_host_upsert", lambda b: folds.fold_host_upsert(b.hosts))
simple("fold_peer_info", lambda b: folds.fold_peer_info(b.identified()[1], b.hosts))
simple("fold_conn_attempt", lambda b: folds.fold_conn_attempt(b.live_attempts(STRICT)))
simple("fold_last_activity", lambda b: folds.fold_last_activity(b.conn_events()))
simple("fold_peer_state", lambda b: b.peer_state(STRICT))


def _geo_events(b):
    """Every address answered twice; the later answer has another owner."""
    rows = b.ips.drop("id")
    old = rows.withColumn("ts", F.lit("2001-07-01").cast("timestamp")).withColumn("seq", F.lit(0))
    new = (
        rows.filter("hosting")
        .withColumn("isp", F.concat("isp", F.lit(" (new)")))
        .withColumn("ts", F.lit("2001-07-02").cast("timestamp"))
        .withColumn("seq", F.lit(1))
    )
    return old.unionByName(new)


simple("fold_ips", lambda b: folds.fold_ips(_geo_events(b)))
simple("fold_eth_nodes", lambda b: folds.fold_eth_nodes(b.records))
simple("fold_eth_nodes_by_seq", lambda b: folds.fold_eth_nodes(b.records, by="seq"))
simple("dq_eth_node_conflicts", lambda b: folds.dq_eth_node_conflicts(b.records))
simple("fold_eth_status", lambda b: folds.fold_chain_answers(normalise.chain_answers(b.connections)))
simple("active_peers_snapshot", lambda b: folds.active_peers_snapshot(b.peers, AS_OF))
simple("insert_attestations", lambda b: folds.insert_attestations(b.attestations))
simple("insert_blocks", lambda b: folds.insert_blocks(b.blocks))
simple("append_conn_events", lambda b: connections.append_conn_events(b.conn_events()))


@query("snapshot_explode")
def _snapshot_explode(b):
    snapshots = folds.active_peers_snapshot(b.peers, AS_OF)
    rows = folds.snapshot_explode(snapshots, b.peers_listed, AS_OF)
    return rows.select("timestamp", "id", "peer_id", "network", "client_name")


#: Days at which snapshots of the test network are taken.
SNAPSHOT_DAYS = ["2001-06-03", "2001-07-03", "2001-08-02", "2001-09-01", "2001-10-01", "2001-12-30"]


def _snapshots(b):
    """Six snapshots, written once as the running job would append them."""
    path = run_dir(b.spark, "snapshots")
    for day in SNAPSHOT_DAYS:
        folds.active_peers_snapshot(b.peers, f"{day} 00:00:00").write.mode("append").parquet(path)
    return b.spark.read.parquet(path)


simple("presence_intervals", lambda b: folds.presence_intervals(_snapshots(b)))
simple(
    "network_at",
    lambda b: folds.network_at(_snapshots(b), b.peers_listed, "2001-09-20 12:00:00").select("timestamp", "id", "peer_id", "network"),
)


@query("sender_sketches")
def _sender_sketches(b):
    """Senders per topic and day from hourly sketches, beside the exact count: within 5 % or one."""
    days = F.to_date("window_start").cast("string").alias("day")
    estimated = distributions.united_senders(distributions.sender_sketches(b.messages), days, "topic")
    exact = b.messages.groupBy(F.to_date("arrival_time").cast("string").alias("day"), "topic").agg(F.count_distinct("sender").alias("exact"))
    off = F.abs(F.col("peers") - F.col("exact"))
    return exact.join(estimated, ["day", "topic"], "left").select(
        "day", "topic", "exact", F.coalesce(off <= F.greatest(F.lit(1.0), 0.05 * F.col("exact")), F.lit(False)).alias("close")
    )


# ------------------------------------------------------------ lookups

simple("full_host_info", lambda b: lookups.full_host_info(b.peers, SHOWN_PEER))
simple("persistable_peer", lambda b: lookups.persistable_peer(b.peers_listed, SHOWN_PEER))
simple(
    "peer_exists",
    lambda b: lookups.peer_exists(
        b.events.select("peer_id").distinct(), folds.fold_host_upsert(b.hosts)
    ),
)
simple("connectable_peers", lambda b: lookups.connectable_peers(b.peers_listed, NET))
simple("ip_info", lambda b: lookups.ip_info(b.ips, SHOWN_IP))
simple("expired_ips", lambda b: lookups.expired_ips(b.ips, AS_OF))
simple(
    "ip_record_status",
    lambda b: lookups.ip_record_status(b.peers_listed.select("ip").distinct(), b.ips, AS_OF),
)
simple("ips_to_locate", lambda b: lookups.ips_to_locate(b.peers_listed, b.ips, AS_OF))
simple("networks", lambda b: reports.networks(b.peers_listed))
simple(
    "discovered_valid_nodes",
    lambda b: lookups.discovered_valid_nodes(b.discoveries).select("peer_id", "seq", "node_ip", "node_tcp"),
)
simple("discovered_dedup", lambda b: lookups.discovered_dedup(b.discoveries).select("peer_id", "seq", "multi_addrs"))
simple("public_discoveries", lambda b: lookups.public_discoveries(b.hosts).select("seq", "ip", "is_public"))

# ------------------------------------------------------------ distributions

simple("client_distribution", lambda b: distributions.client_distribution(b.peers, AS_OF, NET))
simple("version_distribution", lambda b: distributions.version_distribution(b.peers, AS_OF, NET))
simple("geo_distribution", lambda b: distributions.geo_distribution(b.peers, b.ips, AS_OF, NET))
simple("os_distribution", lambda b: distributions.os_distribution(b.peers, AS_OF, NET))
simple("arch_distribution", lambda b: distributions.arch_distribution(b.peers, AS_OF, NET))
simple("hosting_distribution", lambda b: distributions.hosting_distribution(b.peers, b.ips, AS_OF, NET))
simple("rtt_distribution", lambda b: distributions.rtt_distribution(b.peers, AS_OF, NET))
simple("ip_distribution", lambda b: distributions.ip_distribution(b.peers, AS_OF, NET))
simple("fork_distribution", lambda b: distributions.fork_distribution(b.eth_nodes, AS_OF))
simple("attnets_distribution", lambda b: distributions.attnets_distribution(b.eth_nodes, AS_OF))
simple("deprecated_count", lambda b: distributions.deprecated_count(b.peers_listed, NET))
simple("node_distribution", lambda b: distributions.node_distribution(b.peers_listed, NET))
simple("delay_distribution", lambda b: distributions.delay_distribution(retry.queued(b.retry_state())))
simple(
    "total_error_distribution",
    lambda b: distributions.total_error_distribution(retry.queued(b.retry_state())),
)
simple(
    "iteration_delay_distribution",
    lambda b: distributions.iteration_delay_distribution(b.retry_state(), LAST_DAY, EVENTS_AS_OF),
)
simple(
    "iteration_error_distribution",
    lambda b: distributions.iteration_error_distribution(b.retry_state(), LAST_DAY, EVENTS_AS_OF),
)
simple(
    "iteration_attempts",
    lambda b: distributions.iteration_attempts(b.retry_state(), LAST_DAY, EVENTS_AS_OF),
)
simple("dial_passes", lambda b: passes.dial_passes(b.attempts, PASS_GAP))
simple("last_pass", lambda b: passes.last_pass(b.attempts, PASS_GAP))


def _last_pass(b):
    return passes.attempted_in_last_pass(b.retry_state(), b.attempts, PASS_GAP)


simple("last_pass_delay_distribution", lambda b: distributions.delay_distribution(_last_pass(b)))
simple("last_pass_error_distribution", lambda b: distributions.total_error_distribution(_last_pass(b)))
simple("iteration_time", lambda b: distributions.iteration_time(b.attempts))
simple("connected_peers", lambda b: distributions.connected_peers(b.halves, EVENTS_AS_OF))
simple("peers_per_topic", lambda b: distributions.peers_per_topic(b.messages))
simple("messages_per_topic", lambda b: distributions.messages_per_topic(b.messages))
simple("messages_total", lambda b: distributions.messages_total(b.messages))
simple("head_slot", lambda b: distributions.head_slot(b.identified()[2]))
simple("supported_protocols", lambda b: distributions.supported_protocols(b.peers_listed, NET))

# ------------------------------------------------------------ reports

simple("peer_locations", lambda b: reports.peer_locations(b.peers_listed, b.ips))
simple("all_ips", lambda b: reports.all_ips(b.peers_listed, b.ips))
simple("country_stats", lambda b: reports.country_stats(b.peers_listed, b.ips))
simple("city_stats", lambda b: reports.city_stats(b.peers_listed, b.ips))
simple("hosting_stats", lambda b: reports.hosting_stats(b.peers_listed, b.ips))
simple("as_stats", lambda b: reports.as_stats(b.peers_listed, b.ips))
simple("client_stats", lambda b: reports.client_stats(b.peers_listed))
simple("country_top", lambda b: reports.country_top(b.peers_listed, b.ips))
simple("city_top50", lambda b: reports.city_top50(b.peers_listed, b.ips))
simple("hosting_top20", lambda b: reports.hosting_top20(b.peers_listed, b.ips))
simple("network_locations_outer", lambda b: reports.network_locations_outer(b.peers, b.ips, D.POLYGON))
simple("peer_locations_small_10", lambda b: reports.peer_locations_small(b.peers_listed, b.ips, columns=10))
simple("peer_locations_small_7", lambda b: reports.peer_locations_small(b.peers_listed, b.ips, columns=7))


@query("export_all")
def _export_all(b):
    """All exports of every network; counts the lines of every file."""
    folder = run_dir(b.spark, "exports")
    lines = None
    for key, path in sinks.export_networks(b.peers_listed, b.ips, folder).items():
        n = b.spark.read.option("header", True).csv(path).groupBy("file").agg(
            F.count(F.lit(1)).alias("n")
        )
        lines = n if lines is None else lines.unionByName(n)
    return lines


# ------------------------------------------------------------ audit

simple("peers_by_network", lambda b: audit.peers_by_network(b.peers_listed))
simple("contamination", lambda b: audit.contamination(b.peers_listed))
simple("ip_overlap", lambda b: audit.ip_overlap(b.peers_listed))
simple("ip_overlap_share", lambda b: audit.ip_overlap_share(b.peers_listed))
simple("geo_coverage", lambda b: audit.geo_coverage(b.peers_listed, b.ips))
simple(
    "activity_range",
    lambda b: audit.activity_range(
        b.peers, b.ips, "2001-06-01 00:00:00", AS_OF, reports.country_stats
    ),
)
simple("networks_all_counts", lambda b: audit.networks_all_counts(b.peers_listed))

# ------------------------------------------------------------ state and graph

simple(
    "pair_conn_events",
    lambda b: b.conn_events().select("seq", *connections.CONN_EVENT_COLUMNS),
)
simple("peer_retry_state", lambda b: b.retry_state())
simple("retry_history", lambda b: retry.retry_history(b.attempts, b.hosts, STRICT, EVENTS_AS_OF))
simple("delay_policy", lambda b: b.retry_state(CUSTOM))
simple("deprecate_peers", lambda b: retry.deprecate_peers(b.attempts, b.hosts, STRICT, EVENTS_AS_OF))
simple("ready_queue", lambda b: retry.ready_queue(b.retry_state(), EVENTS_AS_OF))
simple("neighbour_edges", lambda b: graph.neighbour_edges(b.probes))
simple("neighbour_errors", lambda b: graph.neighbour_errors(b.probes))


@query("crawl_frontier")
def _crawl_frontier(b):
    edges = graph.neighbour_edges(b.probes)
    seeds = b.probes.select(F.min("peer").alias("peer"))
    return graph.crawl_frontier(edges, seeds)


# Another strategy: refused dials are hopeless, hope grows as well.
CUSTOM = RetryPolicy(
    classes=(
        (D.POSITIVE, ("none",)),
        (D.NO_HOPE, ("connection_refused", "no_route_to_host")),
        (D.TIMEOUT, ("io_timeout",)),
    ),
    base_seconds={D.POSITIVE: 60, D.HOPE: 30, D.NO_HOPE: 600, D.TIMEOUT: 1920},
    growing=(D.TIMEOUT, D.HOPE),
    max_seconds=7200,
    deprecate_after=3 * 86400,
)

# ------------------------------------------------------------ streams


def _stream(name, build):
    """A query that runs a stream to its end and reads what it wrote."""

    def run(b):
        path = jobs.stream_path(b.spark, name)
        out = build(jobs.event_stream(b.spark, b.dir), b)
        schema = out.schema
        jobs.run_to_end(out, path)
        return b.spark.read.schema(schema).parquet(path)

    query(name)(run)


_stream("gossip_stream", lambda ev, b: jobs.gossip_stream(ev, "block", bridge.SELF_ID))
_stream(
    "timed_attestations",
    lambda ev, b: jobs.attestation_event_stream(
        jobs.gossip_stream(ev, "attestation", bridge.SELF_ID), b.peers_listed
    ),
)
@query("published_batches")
def _published_batches(b):
    path = jobs.stream_path(b.spark, "published")
    stream = jobs.gossip_stream(jobs.event_stream(b.spark, b.dir), "attestation", bridge.SELF_ID)
    jobs.publish_timed(stream, tables.bucketed(b.peers_listed, "peer_id"), path)
    return b.spark.read.parquet(path).select("key", "topic", "value")


@query("dedup_table")
def _dedup_table(b):
    stream = jobs.gossip_stream(jobs.event_stream(b.spark, b.dir), "attestation", bridge.SELF_ID)
    return jobs.dedup_table(stream, jobs.stream_path(b.spark, "messages"))[1]().select("msg_id")


_stream(
    "dedup_gossip",
    lambda ev, b: jobs.dedup_gossip(
        jobs.gossip_stream(ev, "attestation", bridge.SELF_ID)
    ).select("msg_id"),
)
_stream("message_rates", lambda ev, b: jobs.message_rates(bridge.messages(ev)))


_stream("pair_conn_stream", lambda ev, b: jobs.pair_conn_stream(bridge.conn_halves(ev), "0 seconds").select("seq", *connections.CONN_EVENT_COLUMNS))


def _dial_logs(ev):
    return normalise.normalise_peers(bridge.discoveries(ev)), normalise.normalise_attempts(bridge.raw_dials(ev))


@query("retry_state_stream")
def _retry_stream(b):
    """The last state of every peer that the stream has emitted."""
    path = jobs.stream_path(b.spark, "retry")
    out = jobs.retry_state_stream(*_dial_logs(jobs.event_stream(b.spark, b.dir)), "0 seconds", STRICT)
    jobs.run_to_end(out, path)
    rows = b.spark.read.schema(out.schema).parquet(path)
    order = F.struct("life", "last_attempt")
    return rows.groupBy("peer_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "peer_id"]), order).alias("s")).select("peer_id", "s.*")


_stream("due_stream", lambda ev, b: jobs.due_stream(*_dial_logs(ev), "0 seconds", STRICT))


@query("fold_stream")
def _fold_stream(b):
    ev = jobs.event_stream(b.spark, b.dir)
    hosts, attempts = _dial_logs(ev)
    answers = normalise.identify_events(bridge.raw_connections(ev))[1]
    path = jobs.stream_path(b.spark, "fold")
    return jobs.fold_peer_stream(hosts, answers, attempts, bridge.conn_halves(ev), path, "0 seconds", STRICT)


def _fold_stream_of(name, rows, *keys):
    """A query that keeps a table folded from a stream and reads the table."""
    query(name)(lambda b: jobs.fold_to_end(rows(b), jobs.stream_path(b.spark, name), *keys))


def _as_stream(b, name, rows):
    """A log that no event file holds, written once and read as a stream of files."""
    path = jobs.stream_path(b.spark, name)
    rows.write.parquet(path)
    return b.spark.readStream.schema(rows.schema).parquet(path)


def _event_log(b):
    return jobs.event_stream(b.spark, b.dir)


_fold_stream_of(
    "fold_stream_status", lambda b: folds.fold_chain_answers(normalise.chain_answers(bridge.raw_connections(_event_log(b)))), "peer_id"
)
_fold_stream_of(
    "fold_stream_attestations", lambda b: folds.insert_attestations(jobs.gossip_stream(_event_log(b), "attestation", bridge.SELF_ID)), "msg_id"
)
_fold_stream_of("fold_stream_blocks", lambda b: folds.insert_blocks(jobs.gossip_stream(_event_log(b), "block", bridge.SELF_ID)), "msg_id")
_fold_stream_of("fold_stream_ips", lambda b: folds.fold_ips(_as_stream(b, "geo", _geo_events(b))), "ip")


@query("fold_stream_nodes")
def _fold_stream_nodes(b):
    rows = folds.node_rows(normalise.normalise_records(_as_stream(b, "records", b.raw_records)))
    return folds.nodes_by_pair(jobs.fold_to_end(rows, jobs.stream_path(b.spark, "nodes"), "node_id"))


@query("metrics_tick")
def _metrics_tick(b):
    path = jobs.stream_path(b.spark, "metrics")

    def build(batch):
        return all_gauges(b, NET, batch)

    jobs.metrics_tick(jobs.event_stream(b.spark, b.dir), path, build)
    return b.spark.read.parquet(path).drop("tick")


@query("snapshot_tick")
def _snapshot_tick(b):
    path = jobs.stream_path(b.spark, "snapshots")
    jobs.snapshot_tick(
        jobs.event_stream(b.spark, b.dir), path, lambda: b.peers, lambda batch: AS_OF
    )
    return b.spark.read.parquet(path).drop("tick")


def queries():
    return dict(REGISTRY)


__all__ = ["queries", "flat", "Inputs", "handlers"]
