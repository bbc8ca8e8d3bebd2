"""Event logs in, current tables out.

Each fold is one grouping with `max_by` / `min_by` over the position (ts, seq).
Both combine on the map side, so a key that owns a third of the log arrives at
the reducer as one partial row per task.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from peerlens.schemas import PEER_INFO
from peerlens.session import cut

#: Parts that a pair of keys claimed by many nodes is split into.
CONFLICT_SALTS = 32
EPOCH_START = "0001-01-01 00:00:00"


def position():
    return F.struct("ts", "seq")


def _last(column, guard=None):
    """Value of the last event that carries `column`."""
    here = F.col(guard or column).isNotNull()
    return F.max_by(F.when(here, F.col(column)), F.when(here, position()))


def _last_pos(column):
    return F.max(F.when(F.col(column).isNotNull(), position()))


def _typed(df, **columns):
    """Tagged event rows: key, position and the given groups, the rest absent."""
    return df.select("peer_id", "ts", "seq", *[c.alias(n) for n, c in columns.items()])


HOST_FIELDS = ["multi_addrs", "ip", "port"]
PEER_FIELDS = [
    "user_agent", "client_name", "client_version", "client_os", "client_arch",
    "protocol_version", "sup_protocols", "latency",
]


def fold_host_upsert(hosts):
    """First network, last addresses; a new sighting clears `deprecated`."""
    return (
        hosts.groupBy("peer_id")
        .agg(
            F.min_by("network", position()).alias("network"),
            F.max_by(F.struct(*HOST_FIELDS), position()).alias("h"),
        )
        .select("peer_id", "network", "h.*", F.lit(False).alias("deprecated"))
    )


def _effective(last, last_pos, born):
    """A write counts only if the peer row existed by then.

    It is enough to look at the last write: the earlier ones are older still.
    """
    return F.when(F.col(last_pos) >= F.col(born), F.col(last))


def fold_peer_info(peer_events, hosts):
    """Identity columns of known peers; answers before the first sighting are lost."""
    log = _typed(hosts, born=F.lit(True)).unionByName(
        _typed(peer_events, p=F.struct(*PEER_FIELDS)), allowMissingColumns=True
    )
    return (
        log.groupBy("peer_id")
        .agg(
            F.min(F.when(F.col("born"), position())).alias("born"),
            _last("p").alias("p"),
            _last_pos("p").alias("p_pos"),
        )
        .filter(F.col("born").isNotNull())
        .withColumn("p", _effective("p", "p_pos", "born"))
        .select("peer_id", "p.*")
    )


def fold_conn_attempt(live_attempts):
    """Control columns after the attempts of the peers' lives."""
    positive = F.col("status") == "positive"
    when = F.unix_timestamp("ts")
    rows = live_attempts.withColumn("success", F.when(positive, when)).withColumn(
        "try", F.struct(when.alias("last_conn_attempt"), F.col("error").alias("last_error"),
                        (~positive & F.col("deprecable")).alias("deprecated"))
    )
    return (
        rows.groupBy("peer_id")
        .agg(_last("try").alias("t"), _last("success").alias("last_activity"))
        .select(
            "peer_id",
            "t.deprecated",
            F.lit(True).alias("attempted"),
            "last_activity",
            "t.last_conn_attempt",
            "t.last_error",
        )
    )


def fold_last_activity(conn_events):
    """Last written disconnect time (not the greatest)."""
    return conn_events.groupBy("peer_id").agg(
        F.max_by("disconn_time", position()).alias("last_activity")
    )


def fold_peer_state(hosts, peer_events, live_attempts, conn_events, prior=None):
    """The full `peer_info`: one grouping over the four logs and the prior table."""
    positive = F.col("status") == "positive"
    when = F.unix_timestamp("ts")
    parts = [
        _typed(
            hosts,
            born=F.lit(True),
            network=F.col("network"),
            host=F.struct(*HOST_FIELDS),
            gone=F.lit(False),
        ),
        _typed(peer_events, p=F.struct(*PEER_FIELDS)),
        _typed(
            live_attempts,
            tried=F.struct(when.alias("last_conn_attempt"), F.col("error").alias("last_error")),
            activity=F.when(positive, when),
            gone=(~positive & F.col("deprecable")),
        ),
        _typed(conn_events, activity=F.col("disconn_time")),
    ]
    if prior is not None:
        # The stored row is an event before all others.
        old = prior.withColumn("ts", F.lit(EPOCH_START).cast("timestamp")).withColumn(
            "seq", F.lit(-1).cast("long")
        )
        parts.append(
            _typed(
                old,
                born=F.lit(True),
                network=F.col("network"),
                host=F.struct(*HOST_FIELDS),
                gone=F.col("deprecated"),
                p=F.when(F.col("client_name").isNotNull(), F.struct(*PEER_FIELDS)),
                tried=F.when(
                    F.col("attempted"), F.struct("last_conn_attempt", "last_error")
                ),
                activity=F.col("last_activity"),
            )
        )
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    folded = (
        log.groupBy("peer_id")
        .agg(
            F.min(F.when(F.col("born"), position())).alias("born"),
            F.min_by("network", F.when(F.col("network").isNotNull(), position())).alias("network"),
            _last("host").alias("host"),
            *[
                expression
                for name in ("p", "tried", "activity", "gone")
                for expression in (_last(name).alias(name), _last_pos(name).alias(f"{name}_pos"))
            ],
        )
        .filter(F.col("born").isNotNull())
    )
    for name in ("p", "tried", "activity", "gone"):
        folded = folded.withColumn(name, _effective(name, f"{name}_pos", "born"))
    return folded.select(
        "peer_id",
        "network",
        "host.*",
        "p.*",
        F.col("gone").alias("deprecated"),
        F.when(F.col("tried").isNotNull(), F.lit(True)).alias("attempted"),
        F.col("activity").alias("last_activity"),
        "tried.last_conn_attempt",
        "tried.last_error",
    )


PEER_STATE_COLUMNS = [f.name for f in PEER_INFO.fields if f.name != "id"]


def fold_ips(events, prior=None, key="ip"):
    """The last whole row per address; `prior` rows are older than every event."""
    columns = [c for c in events.columns if c not in ("ts", "seq", key)]
    if prior is not None:
        old = prior.select(
            key, *columns, F.lit(EPOCH_START).cast("timestamp").alias("ts"), F.lit(-1).alias("seq")
        )
        events = events.unionByName(old)
    return (
        events.groupBy(key)
        .agg(F.max_by(F.struct(*columns), position()).alias("r"))
        .select(key, "r.*")
    )


NODE_FIELDS = [
    "timestamp", "seq", "ip", "tcp", "udp", "fork_digest", "next_fork_version", "attnets",
    "attnets_number",
]


def node_rows(events, by="arrival", prior=None):
    """One row per node, with its first (peer_id, pubkey) and arrival; a grouping, so it also runs on a stream."""
    if prior is not None:
        columns = ["node_id", "peer_id", "pubkey", *NODE_FIELDS]
        old = prior.select(*columns, F.lit(-1).alias("ord"))
        events = events.select(*columns, "ord").unionByName(old)
    rank = F.struct("ord") if by == "arrival" else F.struct("seq", "ord")
    return (
        events.groupBy("node_id")
        .agg(
            F.max_by(F.struct(*NODE_FIELDS), rank).alias("r"),
            F.min_by(F.struct("peer_id", "pubkey"), "ord").alias("k"),
            F.min("ord").alias("first_ord"),
        )
        .select("node_id", "k.*", "r.*", "first_ord")
    )


def _own_key():
    """A pair with a NULL is never the same as another: such a node is a group of its own."""
    return F.when(F.col("peer_id").isNull() | F.col("pubkey").isNull(), F.col("node_id")).alias("own")


def fold_eth_nodes(events, by="arrival", prior=None):
    """Current node records.

    `by='arrival'` takes the last announcement, `by='seq'` the highest record
    sequence.  peer_id and pubkey keep their first value, and a pair of them
    belongs to the node that announced it first (a NULL in it keeps every node).  `prior` rows precede all
    events (arrival numbers `ord` start at 0).
    """
    return nodes_by_pair(node_rows(events, by, prior))


def nodes_by_pair(rows):
    """`node_rows` without the nodes whose (peer_id, pubkey) belongs to an earlier one."""
    columns = [c for c in rows.columns if c not in ("peer_id", "pubkey")]
    return (
        rows.groupBy("peer_id", "pubkey", _own_key())
        .agg(F.min_by(F.struct(*columns), F.struct("first_ord", "node_id")).alias("n"))
        .select("peer_id", "pubkey", "n.*")
        .drop("first_ord")
    )


def dq_eth_node_conflicts(events, by="arrival"):
    """Nodes turned away because another node owns their (peer_id, pubkey), from one pass over the fold.

    A window by the pair would gather a pair that many nodes claim in one task: the owner is found per
    salt of the node first, then among the salts' owners, and met again by (pair, salt).
    """
    salt = F.pmod(F.xxhash64("node_id"), F.lit(CONFLICT_SALTS)).alias("salt")
    rows = cut(node_rows(events, by).filter("peer_id IS NOT NULL AND pubkey IS NOT NULL").select("node_id", "peer_id", "pubkey", "first_ord", salt), "nodes")
    first = F.min(F.struct("first_ord", "node_id")).alias("first")
    parts = rows.groupBy("peer_id", "pubkey", "salt").agg(first)
    owners = parts.groupBy("peer_id", "pubkey").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
    owners = owners.select("peer_id", "pubkey", F.col("first.node_id").alias("owner"), F.explode("salts").alias("salt"))
    return (
        rows.join(owners, ["peer_id", "pubkey", "salt"])
        .filter(F.col("node_id") != F.col("owner"))
        .select("node_id", "peer_id", "pubkey", "owner")
    )


STATUS_FIELDS = ["fork_digest", "finalized_root", "finalized_epoch", "head_root", "head_slot"]
METADATA_FIELDS = ["seq_number", "attnets", "syncnets"]


def fold_eth_status(status, metadata, prior=None):
    """Status and metadata columns change independently; the timestamp is the last of either."""
    parts = [_typed(status, s=F.struct(*STATUS_FIELDS)), _typed(metadata, m=F.struct(*METADATA_FIELDS))]
    if prior is not None:
        old = prior.withColumn("ts", F.timestamp_seconds("timestamp")).withColumn(
            "seq", F.lit(-1).cast("long")
        )
        parts.append(
            _typed(
                old,
                s=F.when(F.col("fork_digest").isNotNull(), F.struct(*STATUS_FIELDS)),
                m=F.when(F.col("seq_number").isNotNull(), F.struct(*METADATA_FIELDS)),
            )
        )
    return fold_chain_answers(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def fold_chain_answers(log):
    """`fold_eth_status` of one log whose rows carry a status `s`, metadata `m`, or both (`normalise.chain_answers`)."""
    return (
        log.groupBy("peer_id")
        .agg(
            F.unix_timestamp(F.max(position())["ts"]).alias("timestamp"),
            _last("s").alias("s"),
            _last("m").alias("m"),
        )
        .select("peer_id", "timestamp", "s.*", "m.*")
    )


# ------------------------------------------------------------ snapshots


SNAPSHOT_CHUNK = 65536


def active_peers_snapshot(peers, as_of, chunk=SNAPSHOT_CHUNK):
    """Ids of all active peers as sorted arrays, stamped `as_of`.

    A snapshot is split into rows of at most `chunk` consecutive ids, so no
    task holds all ids; without an active peer there is no row.
    """
    from peerlens.operators.predicates import active_peers

    ids = active_peers(peers, as_of).select(F.col("id").cast("long").alias("id"))
    return (
        ids.groupBy(F.floor(F.col("id") / chunk).cast("int").alias("chunk"))
        .agg(F.sort_array(F.collect_list("id")).alias("peers"))
        .select(F.lit(as_of).cast("timestamp").alias("timestamp"), "chunk", "peers")
    )


def snapshot_explode(snapshots, peers, as_of):
    """Peer rows present in the snapshot taken at `as_of`."""
    return _present(snapshots.filter(F.col("timestamp") == F.lit(as_of).cast("timestamp")), peers)


def network_at(snapshots, peers, moment):
    """Peer rows of the network as it was at `moment`: those of the newest snapshot not after it."""
    moment = F.lit(moment).cast("timestamp")
    newest = snapshots.filter(F.col("timestamp") <= moment).agg(F.max("timestamp"))
    return _present(snapshots.filter(F.col("timestamp") == newest.scalar()), peers)


def _present(snapshots, peers):
    return snapshots.select("timestamp", F.explode("peers").alias("id")).join(peers, "id")


def presence_intervals(snapshots):
    """(id, present_from, present_to, snapshots): the longest runs of consecutive snapshots that hold a peer.

    The window over all stamps has one row per snapshot, that over a peer at most as many; a snapshot that was skipped
    because nobody was active is not a gap.
    """
    stamps = snapshots.select("timestamp").distinct()
    ticks = stamps.withColumn("tick", F.row_number().over(Window.orderBy("timestamp")))
    rows = snapshots.select("timestamp", F.explode("peers").alias("id")).join(ticks, "timestamp")
    run = F.col("tick") - F.row_number().over(Window.partitionBy("id").orderBy("tick"))
    return rows.withColumn("run", run).groupBy("id", "run").agg(
        F.min("timestamp").alias("present_from"), F.max("timestamp").alias("present_to"), F.count(F.lit(1)).alias("snapshots")
    ).drop("run")


# ------------------------------------------------------------ gossip tables


def first_by_message(events, existing=None):
    """First arrival per message id, slot 0 left out, known ids left out."""
    columns = [c for c in events.columns if c not in ("msg_id", "seq")]
    rows = (
        events.filter(F.col("slot") != 0)
        .groupBy("msg_id")
        .agg(F.min_by(F.struct(*columns), F.struct("arrival_time", "seq")).alias("r"))
        .select("msg_id", "r.*")
    )
    if existing is not None:
        rows = rows.join(existing.select("msg_id"), "msg_id", "left_anti")
    return rows


insert_attestations = first_by_message
insert_blocks = first_by_message
