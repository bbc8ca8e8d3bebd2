"""Declared schemas of the eight tables (never inferred).

Fixed values: column names, their order and types.
"""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields):
    return StructType([StructField(name, kind, True) for name, kind in fields])


S, I, L, B, R, T = StringType(), IntegerType(), LongType(), BooleanType(), FloatType(), TimestampType()

PEER_INFO = _struct(
    ("id", I), ("peer_id", S), ("network", S), ("multi_addrs", ArrayType(S)),
    ("ip", S), ("port", I), ("user_agent", S), ("client_name", S),
    ("client_version", S), ("client_os", S), ("client_arch", S),
    ("protocol_version", S), ("sup_protocols", ArrayType(S)), ("latency", I),
    ("deprecated", B), ("attempted", B), ("last_activity", L),
    ("last_conn_attempt", L), ("last_error", S),
)

IPS = _struct(
    ("id", I), ("ip", S), ("expiration_time", T), ("continent", S),
    ("continent_code", S), ("country", S), ("country_code", S), ("region", S),
    ("region_name", S), ("city", S), ("zip", S), ("lat", R), ("lon", R),
    ("isp", S), ("org", S), ("as_raw", S), ("asname", S), ("mobile", B),
    ("proxy", B), ("hosting", B),
)

CONN_EVENTS = _struct(
    ("id", I), ("peer_id", S), ("direction", S), ("conn_time", L),
    ("latency", L), ("disconn_time", L), ("identified", B), ("error", S),
)

ACTIVE_PEERS = _struct(("timestamp", T), ("chunk", I), ("peers", ArrayType(L)))

ETH_NODES = _struct(
    ("id", I), ("timestamp", L), ("peer_id", S), ("node_id", S), ("seq", L),
    ("ip", S), ("tcp", I), ("udp", I), ("pubkey", S), ("fork_digest", S),
    ("next_fork_version", S), ("attnets", S), ("attnets_number", I),
)

ETH_STATUS = _struct(
    ("id", I), ("peer_id", S), ("timestamp", L), ("fork_digest", S),
    ("finalized_root", S), ("finalized_epoch", L), ("head_root", S),
    ("head_slot", L), ("seq_number", L), ("attnets", S), ("syncnets", S),
)

ETH_ATTESTATIONS = _struct(
    ("id", I), ("msg_id", S), ("sender", S), ("subnet", I), ("slot", L),
    ("arrival_time", T), ("time_in_slot", R), ("val_pubkey", S),
)

ETH_BLOCKS = _struct(
    ("id", I), ("msg_id", S), ("sender", S), ("slot", L), ("arrival_time", T),
    ("time_in_slot", R), ("val_idx", L),
)

TABLES = {
    "peer_info": PEER_INFO,
    "ips": IPS,
    "conn_events": CONN_EVENTS,
    "active_peers": ACTIVE_PEERS,
    "eth_nodes": ETH_NODES,
    "eth_status": ETH_STATUS,
    "eth_attestations": ETH_ATTESTATIONS,
    "eth_blocks": ETH_BLOCKS,
}

# One geolocation answer, as the lookup service spells it.
GEO_ANSWER = _struct(
    ("query", S), ("status", S), ("continent", S), ("continentCode", S),
    ("country", S), ("countryCode", S), ("region", S), ("regionName", S),
    ("city", S), ("zip", S), ("lat", R), ("lon", R), ("isp", S), ("org", S),
    ("as", S), ("asname", S), ("mobile", B), ("proxy", B), ("hosting", B),
)
