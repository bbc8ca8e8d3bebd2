"""The four normalisation jobs: raw logs to typed event tables.

All are stateless projections, so each works unchanged on a batch or a stream.
"""

from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.functions import address, errors, forks, gossip, user_agent
from peerlens.plans.handlers import DEFAULT_HANDLERS


def normalise_peers(raw):
    """Discovery or identify log to host events (first public address, validity)."""
    addr = address.first_public_addr(F.col("multi_addrs"))
    return (
        raw.withColumn("addr", addr)
        .withColumn("ip", F.col("addr.ip"))
        .withColumn("port", F.col("addr.port"))
        .drop("addr")
    )


def identify_rows(raw):
    """Identify answers to peer events; rows without any identity are left out."""
    return user_agent.with_client(raw.filter(user_agent.is_identified())).select(
        "peer_id",
        "ts",
        "seq",
        "user_agent",
        "client_name",
        "client_version",
        "client_os",
        "client_arch",
        "protocol_version",
        F.col("protocols").alias("sup_protocols"),
        user_agent.latency_ms("latency_ns").alias("latency"),
    )


def normalise_attempts(raw):
    """Raw dials to attempt events: positive iff there was no error message."""
    coded = raw.withColumn("error", errors.classify_dial_error(F.col("message")))
    return coded.select(
        "peer_id",
        "ts",
        "seq",
        F.when(F.col("message").isNull(), "positive").otherwise("negative").alias("status"),
        "error",
        errors.delay_class(F.col("error")).alias("delay_class"),
    )


# A dial outcome becomes an attempt event by the same projection.
conn_attempt_from_dial = normalise_attempts


def split_gossip(messages, self_id, genesis=D.MAINNET_GENESIS, handlers=None):
    """Route every message: `kind`, the reason of rejection, derived columns.

    Kinds without a handler have no rows of their own; their reason is
    'no handler'.  Own messages are 'own message'.
    """
    handlers = handlers or DEFAULT_HANDLERS
    pretty = gossip.topic_pretty(F.col("topic"))
    # Which handler first: the attestation family shares a prefix.
    kind = F.coalesce(*[F.when(h.matches(pretty), F.lit(name)) for name, h in handlers.items()])
    routed = messages.withColumn("kind", kind)
    problem = F.coalesce(
        *[F.when(F.col("kind") == name, h.problem()) for name, h in handlers.items()]
    )
    reason = (
        F.when(F.col("sender") == self_id, "own message")
        .when(F.col("kind").isNull(), "no handler")
        .otherwise(problem)
    )
    return routed.withColumn("reason", reason).withColumn(
        "msg_id", gossip.message_id(F.col("payload"))
    ).withColumn(
        "time_in_slot", gossip.time_in_slot(F.col("arrival_time"), F.col("slot"), F.lit(genesis))
    )


def gossip_to_rows(messages, kind, self_id, genesis=D.MAINNET_GENESIS, handlers=None):
    """Accepted rows of one kind, in that kind's table columns."""
    handlers = handlers or DEFAULT_HANDLERS
    routed = split_gossip(messages, self_id, genesis, handlers)
    accepted = routed.filter((F.col("kind") == kind) & F.col("reason").isNull())
    return accepted.select("msg_id", "sender", *handlers[kind].columns(), "slot", "arrival_time",
                           "time_in_slot", "seq")


def rejected_gossip(messages, self_id, handlers=None):
    """Side output: messages that produced no row, with the reason."""
    return split_gossip(messages, self_id, handlers=handlers).filter(F.col("reason").isNotNull())


def normalise_gossip(messages, self_id, genesis=D.MAINNET_GENESIS):
    """Attestations and blocks, as a pair of event tables."""
    return (
        gossip_to_rows(messages, "attestation", self_id, genesis),
        gossip_to_rows(messages, "block", self_id, genesis),
    )


def gossip_log(messages, self_id, genesis=D.MAINNET_GENESIS, handlers=None):
    """Accepted rows of all kinds from one pass over the log: `kind`, the common columns, and every kind's own columns,
    NULL for the others."""
    handlers = handlers or DEFAULT_HANDLERS
    routed = split_gossip(messages, self_id, genesis, handlers).filter(F.col("kind").isNotNull() & F.col("reason").isNull())
    own = []
    for name, handler in handlers.items():
        packed = F.when(F.col("kind") == name, F.struct(*handler.columns()))
        own += [packed[c].alias(c) for c in routed.select(*handler.columns()).columns]
    return routed.select("kind", "msg_id", "sender", *own, "slot", "arrival_time", "time_in_slot", "seq")


def normalise_records(raw):
    """Announced node records to `eth_nodes` events."""
    return (
        forks.with_eth2_data(raw, "eth2")
        .withColumn("attnets_number", forks.attnets_count(F.col("attnets")))
        .withColumn("attnets_error", forks.attnets_error(F.col("attnets")))
        .withColumn("attnets", F.lower(F.regexp_replace("attnets", "^0x", "")))
        .withColumnRenamed("error", "eth2_error")
        .drop("eth2", "exists", "next_fork_epoch")
    )


def identify_events(connections):
    """One raw connection log to (host events, peer events, status events, metadata events).

    A failed identify yields no host event; a failed request no status or
    metadata event.
    """
    answered = connections.filter(F.col("identify_error").isNull())
    hosts = normalise_peers(answered.select("peer_id", "ts", "seq", "network", "multi_addrs"))
    peers = identify_rows(answered)
    chain = answered.filter(F.col("network") == D.ETHEREUM)
    status = chain.filter(F.col("status_error").isNull()).select(
        "peer_id", "ts", "seq", "fork_digest", "finalized_root", "finalized_epoch",
        "head_root", "head_slot",
    )
    metadata = chain.filter(F.col("metadata_error").isNull()).select(
        "peer_id", "ts", "seq", "seq_number", "attnets", "syncnets"
    )
    return hosts, peers, status, metadata


def _chain_structs():
    """Status and metadata of an answered connection on the chain network, NULL where the request failed."""
    chain = F.col("network") == D.ETHEREUM
    status = F.struct("fork_digest", "finalized_root", "finalized_epoch", "head_root", "head_slot")
    metadata = F.struct("seq_number", "attnets", "syncnets")
    return (
        F.when(chain & F.col("status_error").isNull(), status).alias("s"),
        F.when(chain & F.col("metadata_error").isNull(), metadata).alias("m"),
    )


def chain_answers(connections):
    """The status and metadata events of `identify_events` in one pass over the log; answers with neither are left out."""
    rows = connections.filter(F.col("identify_error").isNull()).select("peer_id", "ts", "seq", *_chain_structs())
    return rows.filter("s IS NOT NULL OR m IS NOT NULL")


def identify_log(connections):
    """All outputs of `identify_events` in one pass: a row per answered connection with the structs `host`, `p` (identity, NULL
    without any), `s` (status) and `m` (metadata)."""
    rows = user_agent.with_client(normalise_peers(connections.filter(F.col("identify_error").isNull())))
    identity = F.struct(
        "user_agent", "client_name", "client_version", "client_os", "client_arch", "protocol_version",
        F.col("protocols").alias("sup_protocols"), user_agent.latency_ms("latency_ns").alias("latency"),
    )
    return rows.select(
        "peer_id", "ts", "seq", F.struct("network", "multi_addrs", "ip", "port").alias("host"),
        F.when(user_agent.is_identified(), identity).alias("p"), *_chain_structs(),
    )
