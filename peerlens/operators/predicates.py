"""Row predicates shared by the live metrics and the exports.

`as_of` is a literal timestamp text; the epoch bound is folded on the driver so
that every term can reach a Parquet scan.
"""

import datetime as dt

from pyspark.sql import functions as F

from peerlens import domains as D


def epoch(as_of):
    """Epoch seconds of a UTC timestamp given as text or datetime."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    return int(as_of.timestamp())


def active_condition(as_of, network=None, attempted=True, days=D.ACTIVE_DAYS):
    """Whether a peer was seen in the activity window; `network=None` means any."""
    keep = ~F.col("deprecated") & F.col("client_name").isNotNull()
    keep = keep & (F.col("last_activity") > epoch(as_of) - days * 86400)
    if attempted:
        keep = keep & F.col("attempted")
    if network is not None:
        keep = keep & (F.col("network") == network)
    return keep


def active_peers(peers, as_of, network=None, attempted=True, days=D.ACTIVE_DAYS):
    return peers.filter(active_condition(as_of, network, attempted, days))


def listed_peers(peers, network=None, since=None, until=None):
    """Peers that exports list: not deprecated, optionally in an activity range."""
    keep = ~F.col("deprecated")
    if network is not None:
        keep = keep & (F.col("network") == network)
    if since is not None:
        keep = keep & (F.col("last_activity") >= epoch(since))
    if until is not None:
        keep = keep & (F.col("last_activity") < epoch(until))
    return peers.filter(keep)


def recent_condition(as_of, days=D.FORK_WINDOW_DAYS):
    """A node record with a fork digest, announced in the window."""
    return F.col("fork_digest").isNotNull() & (F.col("timestamp") > epoch(as_of) - days * 86400)


def recent_nodes(eth_nodes, as_of, days=D.FORK_WINDOW_DAYS):
    return eth_nodes.filter(recent_condition(as_of, days))
