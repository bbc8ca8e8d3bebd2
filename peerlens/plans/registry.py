"""Named metrics and the snapshot of all of them.

Two kinds of metric exist.  A *count* is a row condition with a label, over one
table; all counts over a table are taken in one pass.  A *query* is a
function of the tables and a moment that returns label columns and one value
column.  The snapshot brings all into (module, metric, label, value).
"""

from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.operators import distributions as d
from peerlens.operators import passes
from peerlens.operators.predicates import active_condition, recent_condition


@dataclass
class Tables:
    """DataFrames a metric may read; unset ones stay None."""

    peers: object = None
    ips: object = None
    eth_nodes: object = None
    retry_state: object = None
    halves: object = None
    messages: object = None
    status: object = None
    attempts: object = None


@dataclass(frozen=True)
class Count:
    """Rows of `table` that satisfy `where(as_of)`, per `label` (a Column, or None for one total)."""

    module: str
    name: str
    where: Callable
    label: object = None
    table: str = "peers"


@dataclass(frozen=True)
class Query:
    module: str
    name: str
    build: Callable
    value: str
    labels: tuple = ()
    needs: tuple = ("peers",)


@dataclass
class MetricRegistry:
    metrics: list = field(default_factory=list)
    #: Seconds without a dial that end a pass over the peers.
    pass_gap: int = passes.GAP_SECONDS

    def _add(self, metric):
        if any((m.module, m.name) == (metric.module, metric.name) for m in self.metrics):
            raise ValueError(f"metric {metric.module}.{metric.name} is registered already")
        self.metrics.append(metric)
        return self

    def count(self, module, name, where, label=None, table="peers"):
        return self._add(Count(module, name, where, label, table))

    def query(self, module, name, build, value, labels=(), needs=("peers",)):
        return self._add(Query(module, name, build, value, tuple(labels), tuple(needs)))

    def _counts(self, tables, as_of, network):
        """All count metrics of a table in one scan: each row lists the gauges it adds to."""
        by_table = {}
        for m in self.metrics:
            if isinstance(m, Count) and getattr(tables, m.table) is not None:
                by_table.setdefault(m.table, []).append(m)
        return [self._count_rows(counts, tables, name, as_of, network) for name, counts in by_table.items()]

    def _count_rows(self, counts, tables, name, as_of, network):
        def tag(m, label, weight):
            return F.struct(
                F.lit(m.module).alias("module"),
                F.lit(m.name).alias("metric"),
                F.coalesce(label, F.lit("")).alias("label"),
                weight.cast("long").alias("weight"),
            )

        tags = []
        for m in counts:
            label = F.lit("") if m.label is None else m.label.cast("string")
            tags.append(F.when(m.where(as_of), tag(m, label, label.isNotNull())))
        source = getattr(tables, name)
        if name == "peers" and network is not None:
            source = source.filter(F.col("network") == network)
        if name == "retry_state":
            source = (
                source.withColumn("in_last_pass", F.lit(False)) if tables.attempts is None
                else passes.with_last_pass(source, tables.attempts, self.pass_gap)
            )
        rows = source.select(F.explode(F.array_compact(F.array(*tags))).alias("t"))
        totals = [m for m in counts if m.label is None]
        if totals:
            # A total exists, as 0, even if no row satisfies its condition.
            zero = F.array(*[tag(m, F.lit(""), F.lit(0)) for m in totals])
            rows = rows.unionByName(source.sparkSession.range(1).select(F.explode(zero).alias("t")))
        return rows.groupBy("t.module", "t.metric", "t.label").agg(F.sum("t.weight").cast("double").alias("value"))

    def _queries(self, tables, as_of, network):
        for m in self.metrics:
            if not isinstance(m, Query) or any(getattr(tables, n) is None for n in m.needs):
                continue
            label = F.concat_ws("|", *[F.col(c).cast("string") for c in m.labels])
            yield m.build(tables, as_of, network).select(
                F.lit(m.module).alias("module"),
                F.lit(m.name).alias("metric"),
                (label if m.labels else F.lit("")).alias("label"),
                F.col(m.value).cast("double").alias("value"),
            )

    def snapshot(self, tables, as_of, network=None):
        """All metrics whose tables are present, as long rows."""
        parts = self._counts(tables, as_of, network) + list(self._queries(tables, as_of, network))
        return reduce(lambda a, b: a.unionByName(b), parts)


def default_registry(pass_gap=passes.GAP_SECONDS):
    """The gauges of the crawler, discovery, peering, hosts, gossip and chain modules.

    Fixed values: the metric names.
    """

    def active(as_of):
        return active_condition(as_of)

    def seen(as_of):
        return active_condition(as_of, attempted=False)

    version = F.concat_ws("_", "client_name", "client_version")
    r = MetricRegistry(pass_gap=pass_gap)
    r.count("crawler", "observed_client_distribution", active, F.col("client_name"))
    r.count("crawler", "observed_client_version_distribution", active, version)
    r.count("crawler", "os_distribution", active, F.col("client_os"))
    r.count("crawler", "arch_distribution", active, F.col("client_arch"))
    r.count("crawler", "observed_rtt_distribution", seen, d.latency_range(F.col("latency")))
    r.count("crawler", "node_distribution", lambda _: ~F.col("deprecated"))
    r.count("crawler", "deprecated_nodes", lambda _: F.col("deprecated"))
    r.query("crawler", "geographical_distribution",
            lambda t, at, n: d.geo_distribution(t.peers, t.ips, at, n), "cnt", ["country_code"],
            ["peers", "ips"])
    r.query("crawler", "hosted_peers_distribution",
            lambda t, at, n: d.hosting_distribution(t.peers, t.ips, at, n), "cnt", ["kind"],
            ["peers", "ips"])
    r.query("crawler", "observed_ip_distribution",
            lambda t, at, n: d.ip_distribution(t.peers, at, n), "number_of_ips", ["nodes_per_ip"])
    r.query("hosts", "supported_protocols",
            lambda t, at, n: d.supported_protocols(t.peers, n), "cnt", ["protocol"])
    r.count("discovery", "node_per_fork_distribution", recent_condition, F.col("fork_digest"), "eth_nodes")
    r.count("discovery", "attnets_distribution", recent_condition, F.col("attnets_number"), "eth_nodes")

    def everyone(_):
        return F.lit(True)

    def tried(_):
        return F.col("in_last_pass")

    error = F.coalesce("last_error", F.lit(D.NEVER_TRIED))
    r.count("peering", "pruned_error_distribution", everyone, F.col("delay_class"), "retry_state")
    r.count("peering", "total_conn_error_distribution", everyone, error, "retry_state")
    r.count("peering", "iteration_attempts_by_category_distribution", tried, F.col("delay_class"), "retry_state")
    r.count("peering", "conn_error_distribution", tried, error, "retry_state")
    r.count("peering", "peers_attempted_last_iteration", tried, None, "retry_state")
    r.query("peering", "peerstore_iteration_time_secs",
            lambda t, at, n: passes.last_pass(t.attempts, r.pass_gap), "seconds", (), ["attempts"])
    r.query("hosts", "connected_peers",
            lambda t, at, n: d.connected_peers(t.halves, at), "cnt", (), ["halves"])
    r.query("gossip", "peers_per_topic",
            lambda t, at, n: d.peers_per_topic(t.messages), "peers", ["topic"], ["messages"])
    r.query("gossip", "received_messages_psec",
            lambda t, at, n: d.newest_rates(d.messages_per_topic(t.messages)), "per_second", ["topic"], ["messages"])
    r.query("gossip", "total_received_messages_psec",
            lambda t, at, n: d.newest_rates(d.messages_total(t.messages)), "per_second", (), ["messages"])
    r.query("chain", "local_head_slot",
            lambda t, at, n: d.head_slot(t.status), "head_slot", (), ["status"])
    return r


def metrics_snapshot(tables, as_of, network=None, registry=None):
    return (registry or default_registry()).snapshot(tables, as_of, network)
