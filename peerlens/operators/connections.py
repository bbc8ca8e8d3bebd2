"""Connection events out of open and close notifications."""

from pyspark.sql import functions as F

from peerlens.functions.errors import direction_name
from peerlens.functions.user_agent import latency_ms
from peerlens.operators.timeline import SLICE_SECONDS, with_next


def pair_conn_events(halves, slice_seconds=SLICE_SECONDS):
    """One row per open that is directly followed by a later close of the peer."""
    paired = with_next(halves, "peer_id", ["kind", "ts"], slice_seconds=slice_seconds)
    paired = paired.filter(
        (F.col("kind") == "open")
        & (F.col("following.kind") == "close")
        & (F.col("following.ts") > F.col("ts"))
    )
    return conn_event_rows(paired, "ts", "following.ts")


def conn_event_rows(pairs, opened, closed):
    """Paired halves in the columns of `conn_events`, with the close's time and the open's number as position."""
    return pairs.select(
        "peer_id",
        direction_name(F.col("direction")).alias("direction"),
        F.unix_timestamp(opened).alias("conn_time"),
        latency_ms("latency_ns").cast("long").alias("latency"),
        F.unix_timestamp(closed).alias("disconn_time"),
        "identified",
        "error",
        F.col(closed).alias("ts"),
        "seq",
    )


CONN_EVENT_COLUMNS = [
    "peer_id", "direction", "conn_time", "latency", "disconn_time", "identified", "error",
]


def append_conn_events(paired, persist=True):
    """Rows to append to `conn_events`; none when persisting is switched off."""
    rows = paired.select(CONN_EVENT_COLUMNS)
    return rows if persist else rows.filter(F.lit(False))
