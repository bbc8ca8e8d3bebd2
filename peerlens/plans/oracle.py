"""The SQL twin of every query; column names equal those of the query."""

import re

from peerlens import domains as D
from peerlens.plans.bridge_sql import (
    DIGESTS, MSG_ID, VIEWS, array, by_network, client_name, client_version, delay_class,
    error_code, ip_checked, keywords, lotus_version, q, stamp,
)
from peerlens.plans.queries import SHOWN_IP, SHOWN_PEER
from peerlens.sources import bridge

NET = "network = 'Ethereum CL'"
TXT = "array_to_string({}::VARCHAR[], '|') AS {}"


def joined(column):
    return TXT.format(column, column)


PEER_OUT = f"""id, peer_id, network, {joined('multi_addrs')}, ip, port, user_agent, client_name,
    client_version, client_os, client_arch, protocol_version, {joined('sup_protocols')}, latency,
    deprecated, attempted, last_activity, last_conn_attempt, last_error"""
IPS_OUT = f"""id, ip, {stamp('expiration_time')} AS expiration_time, continent, continent_code, country,
    country_code, region, region_name, city, zip, lat, lon, isp, org, as_raw, asname, mobile, proxy, hosting"""
GEO_TEXT = """continent, continent_code, country, country_code, region, region_name, city, zip,
    lat, lon, isp, org, as_raw, asname, mobile, proxy, hosting"""
LOCATION = """peer_id, network, ip, port, user_agent, client_name, client_version, country, city, lat, lon,
    isp, org, as_raw, asname, hosting"""
MSG_OUT = f"msg_id, sender, slot, {stamp('arrival_time')} AS arrival_time, time_in_slot"
NODE_OUT = """peer_id, pubkey, node_id, timestamp, seq, ip, tcp, udp, fork_digest, next_fork_version,
    attnets, attnets_number"""


def first_messages(source, extra):
    return f"""SELECT msg_id, sender, {extra}, slot, {stamp('arrival_time')} AS arrival_time, time_in_slot
        FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY arrival_time, seq) AS rn
              FROM {source} WHERE slot <> 0) WHERE rn = 1"""


def state_out(prefix, table="state"):
    return f"""SELECT peer_id, life, {stamp('life_start')} AS life_start, delay_class, degree,
        {stamp('last_attempt')} AS last_attempt, {stamp('next_attempt')} AS next_attempt,
        deprecable, last_error FROM {prefix}_{table}"""


LAST_DAY = "last_attempt >= TIMESTAMP '2024-01-30' AND last_attempt < TIMESTAMP '2024-01-31'"
RTT = (
    "CASE "
    + " ".join(f"WHEN latency BETWEEN {a} AND {b} THEN {q(n)}" for a, b, n in D.RTT_BUCKETS)
    + " ELSE '+1s' END"
)
COUNTRY = """SELECT country, country_code, count(DISTINCT peer_id) AS peer_count,
    count(DISTINCT asname) AS unique_asns, sum(CASE WHEN hosting THEN 1 ELSE 0 END)::BIGINT AS hosted_nodes,
    round(avg(lat)::DECIMAL(20,10), 4)::DOUBLE AS avg_lat, round(avg(lon)::DECIMAL(20,10), 4)::DOUBLE AS avg_lon
    FROM {} GROUP BY country, country_code"""

AGENT_BASE = "SELECT seq, network, user_agent, {} AS {} FROM b_connections"
NAMED = client_name("user_agent", "network")
STATE_COLS = {
    "host": ["network", "multi_addrs", "ip", "port"],
    "peer": ["user_agent", "client_name", "client_version", "client_os", "client_arch",
             "protocol_version", "sup_protocols", "latency"],
}


def last_per_peer(source, columns, where="true"):
    packed = ", ".join(f"{c} := {c}" for c in columns)
    return (f"SELECT peer_id, arg_max(struct_pack({packed}), ts) AS r, max(ts) AS at "
            f"FROM {source} WHERE {where} GROUP BY peer_id")


def peer_state(prefix, with_connections=True):
    """Replay of the four logs by last values; `prefix` names the retry views."""
    live = f"{prefix}_live" if prefix else "(SELECT *, false AS deprecable FROM b_attempts)"
    activity = f"SELECT peer_id, ts, epoch(ts)::BIGINT AS v FROM {live} WHERE status = 'positive'"
    if prefix:
        activity = f"SELECT peer_id, ts, floor(epoch(ts))::BIGINT AS v FROM {live} WHERE status = 'positive'"
    else:
        activity = "SELECT peer_id, ts, floor(epoch(ts))::BIGINT AS v FROM b_attempts WHERE status = 'positive'"
    if with_connections:
        activity += " UNION ALL SELECT peer_id, ts, disconn_time AS v FROM b_pairs"
    return f"""
        SELECT h.peer_id, h.network, array_to_string(h.r.multi_addrs, '|') AS multi_addrs, h.r.ip AS ip, h.r.port AS port,
               i.r.user_agent AS user_agent, i.r.client_name AS client_name, i.r.client_version AS client_version,
               i.r.client_os AS client_os, i.r.client_arch AS client_arch,
               i.r.protocol_version AS protocol_version,
               array_to_string(i.r.sup_protocols, '|') AS sup_protocols, i.r.latency AS latency,
               CASE WHEN g.at >= h.born THEN g.gone ELSE false END AS deprecated,
               CASE WHEN t.at >= h.born THEN true END AS attempted,
               CASE WHEN v.at >= h.born THEN v.v END AS last_activity,
               CASE WHEN t.at >= h.born THEN t.ts END AS last_conn_attempt,
               CASE WHEN t.at >= h.born THEN t.error END AS last_error
        FROM (SELECT peer_id, min(ts) AS born, arg_min(network, ts) AS network,
                     arg_max(struct_pack(multi_addrs := multi_addrs, ip := ip, port := port), ts) AS r
              FROM b_discoveries GROUP BY peer_id) h
        LEFT JOIN ({last_per_peer('b_identities', STATE_COLS['peer'])}) i
          ON h.peer_id = i.peer_id AND i.at >= h.born
        LEFT JOIN (SELECT peer_id, max(ts) AS at, floor(epoch(max(ts)))::BIGINT AS ts, arg_max(error, ts) AS error
                   FROM {live} GROUP BY peer_id) t ON h.peer_id = t.peer_id
        LEFT JOIN (SELECT peer_id, max(ts) AS at, arg_max(v, ts) AS v FROM ({activity}) GROUP BY peer_id) v
          ON h.peer_id = v.peer_id
        LEFT JOIN (SELECT peer_id, max(ts) AS at, arg_max(gone, ts) AS gone FROM (
                     SELECT peer_id, ts, false AS gone FROM b_discoveries
                     UNION ALL SELECT peer_id, ts, deprecable AND status <> 'positive' FROM {live})
                   GROUP BY peer_id) g ON h.peer_id = g.peer_id"""


def metric(module, name, label, value, source):
    return f"SELECT {q(module)} AS module, {q(name)} AS metric, {label} AS label, ({value})::DOUBLE AS value FROM {source}"


def crawler_metrics(where):
    active, seen, listed, dead = (
        f"(SELECT * FROM {t} WHERE {where})" for t in ("b_active", "b_seen", "b_listed", "b_dead")
    )
    geo = f"(SELECT i.* FROM {active} p JOIN b_ips i ON p.ip = i.ip)"
    parts = [
        metric("crawler", "observed_client_distribution", "client_name", "count(*)", f"{active} GROUP BY client_name"),
        metric("crawler", "observed_client_version_distribution", "client_name || '_' || client_version", "count(*)",
               f"{active} GROUP BY client_name, client_version"),
        metric("crawler", "os_distribution", "client_os", "count(*)", f"{active} GROUP BY client_os"),
        metric("crawler", "arch_distribution", "client_arch", "count(*)", f"{active} GROUP BY client_arch"),
        metric("crawler", "observed_rtt_distribution", RTT, "count(*)", f"{seen} GROUP BY {RTT}"),
        metric("crawler", "node_distribution", "''", "count(*)", listed),
        metric("crawler", "deprecated_nodes", "''", "count(*)", dead),
        metric("crawler", "geographical_distribution", "country_code", "count(*)", f"{geo} GROUP BY country_code"),
        *[metric("crawler", "hosted_peers_distribution", q(kind), f"count(*) FILTER ({flag})", geo)
          for kind, flag in (("mobile_ips", "mobile"), ("under_proxy", "proxy"), ("hosted_ips", "hosting"))],
        metric("crawler", "observed_ip_distribution", "n::VARCHAR", "count(*)",
               f"(SELECT ip, count(*) AS n FROM {seen} GROUP BY ip) GROUP BY n"),
        metric("hosts", "supported_protocols", "protocol", "count(*)",
               f"(SELECT unnest(sup_protocols) AS protocol FROM b_peers WHERE {where}) GROUP BY protocol"),
    ]
    return parts


VIEWS["b_dead"] = "SELECT * FROM b_peers WHERE deprecated"
CONNECTED = """(SELECT peer_id, arg_max(kind, ts) AS kind FROM b_halves
    WHERE ts <= TIMESTAMP '{}' GROUP BY peer_id) WHERE kind = 'open'"""
VIEWS["b_pass_marks"] = """SELECT ts, seq, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, seq) <= 2700000000 THEN 0 ELSE 1 END AS fresh
    FROM b_attempts"""
VIEWS["b_passes"] = """SELECT pass, min(ts) AS pass_start, max(ts) AS pass_end, count(*) AS attempts,
    (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE AS seconds
    FROM (SELECT ts, (sum(fresh) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::INT AS pass FROM b_pass_marks) GROUP BY pass"""
VIEWS["b_last_pass"] = "SELECT * FROM b_passes WHERE pass = (SELECT max(pass) FROM b_passes)"
PASS_OUT = f"pass, {stamp('pass_start')} AS pass_start, {stamp('pass_end')} AS pass_end, attempts, seconds"
IN_LAST_PASS = "last_attempt >= (SELECT pass_start FROM b_last_pass)"


def node_metrics():
    return [
        metric("discovery", "node_per_fork_distribution", "fork_digest", "count(*)", "b_recent_nodes GROUP BY fork_digest"),
        metric("discovery", "attnets_distribution", "coalesce(attnets_number::VARCHAR, '')", "count(attnets_number)", "b_recent_nodes GROUP BY attnets_number"),
    ]


def event_metrics():
    queue = "r_state WHERE NOT deprecable"
    newest = "WHERE window_start = (SELECT max(window_start) FROM b_rates)"
    return [
        metric("peering", "pruned_error_distribution", "delay_class", "count(*)", f"{queue} GROUP BY delay_class"),
        metric("peering", "total_conn_error_distribution", "last_error", "count(*)", f"{queue} GROUP BY last_error"),
        metric("peering", "iteration_attempts_by_category_distribution", "delay_class", "count(*)",
               f"{queue} AND {IN_LAST_PASS} GROUP BY delay_class"),
        metric("peering", "conn_error_distribution", "last_error", "count(*)", f"{queue} AND {IN_LAST_PASS} GROUP BY last_error"),
        metric("peering", "peers_attempted_last_iteration", "''", "count(*)", f"{queue} AND {IN_LAST_PASS}"),
        metric("peering", "peerstore_iteration_time_secs", "''", "seconds", "b_last_pass"),
        metric("hosts", "connected_peers", "''", "count(*)", CONNECTED.format("2024-01-31 00:00:00")),
        metric("gossip", "peers_per_topic", "topic", "count(DISTINCT sender)", "b_messages GROUP BY topic"),
        metric("gossip", "received_messages_psec", "topic", "per_minute / 60", f"b_rates {newest}"),
        metric("gossip", "total_received_messages_psec", "''", "sum(per_minute) / 60", f"b_rates {newest}"),
        "SELECT 'chain' AS module, 'local_head_slot' AS metric, '' AS label, max(head_slot)::DOUBLE AS value "
        "FROM b_status HAVING count(*) > 0",
    ]


NAME_TO_DIGEST = " ".join(f"WHEN {q(n.lower())} THEN {q(d)}" for n, d in D.FORK_DIGESTS)
FORKS = "FROM b_records WHERE fork_digest IS NOT NULL"
HOSTED = "sum(CASE WHEN hosting THEN 1 ELSE 0 END)::BIGINT AS hosted_nodes"
OVERLAP = """SELECT a.network AS network_a, b.network AS network_b, count(*) AS shared_ips
    FROM b_pairs_ip a JOIN b_pairs_ip b ON a.ip = b.ip AND a.network < b.network GROUP BY 1, 2"""
VIEWS["b_pairs_ip"] = "SELECT DISTINCT network, ip FROM b_listed"
VIEWS["b_ip_sizes"] = "SELECT network, count(*) AS n FROM b_pairs_ip GROUP BY 1"
VIEWS["b_overlap"] = OVERLAP
VIEWS["b_rates"] = """SELECT floor(epoch(arrival_time))::BIGINT // 15 * 15 AS window_start, topic, count(*) AS cnt,
    count(*) * 4.0::DOUBLE AS per_minute FROM b_messages GROUP BY 1, 2"""
for _n, _prev in enumerate(range(6)):
    _old = " UNION ALL ".join(f"SELECT peer FROM g_{i}" for i in range(_n + 1))
    VIEWS[f"g_{_n + 1}"] = (
        f"SELECT DISTINCT neighbour AS peer FROM b_edges JOIN g_{_n} g ON b_edges.peer = g.peer "
        f"WHERE neighbour NOT IN ({_old})"
    )
VIEWS["g_0"] = "SELECT min(peer) AS peer FROM b_probes"

TIMED_JSON = """json_object('slot', slot, 'subnet', subnet)"""
TIMED_FULL = f"""json_object('attestation', {TIMED_JSON},
    'attestation_extra_data', json_object(
        'arrived_at', strftime(arrival_time, '%Y-%m-%dT%H:%M:%S.%fZ'), 'peer_msg_id', msg_id,
        'subnet', subnet, 'time_in_slot', round(time_in_slot * 1000000000)::BIGINT),
    'peer_info', json_object(
        'id', sender, 'ip', coalesce(p.ip, ''), 'port', coalesce(p.port, 0),
        'user_agent', coalesce(p.user_agent, ''), 'latency', coalesce(p.latency::BIGINT * 1000000, 0),
        'protocols', coalesce(p.sup_protocols, []), 'protocol_version', coalesce(p.protocol_version, '')))"""
PUBLISHED = f"""
    SELECT msg_id AS key, 'ethereum_attestation' AS topic, json_object('attestation', {TIMED_JSON})::VARCHAR AS value
    FROM b_attestations
    UNION ALL
    SELECT msg_id, 'timed_ethereum_attestation', {TIMED_FULL}::VARCHAR
    FROM b_attestations a LEFT JOIN b_peers p ON a.sender = p.peer_id"""
ATT_TABLE = first_messages("b_attestations", "subnet, '' AS val_pubkey")
BLOCK_TABLE = first_messages("b_blocks", "val_idx")
REAL = "time_in_slot::FLOAT::DOUBLE AS time_in_slot"
STATUS_FIELDS = ["fork_digest", "finalized_root", "finalized_epoch", "head_root", "head_slot"]
META_FIELDS = ["seq_number", "attnets", "syncnets"]
VIEWS["b_eth_status"] = f"""
    SELECT peer_id, floor(epoch(greatest(s.at, m.at)))::BIGINT AS timestamp,
           {', '.join(f's.r.{c} AS {c}' for c in STATUS_FIELDS)}, {', '.join(f'm.r.{c} AS {c}' for c in META_FIELDS)}
    FROM ({last_per_peer('b_status', STATUS_FIELDS)}) s
    FULL JOIN ({last_per_peer('b_metadata', META_FIELDS)}) m USING (peer_id)"""
EXPORT_ROWS = {
    "peers": "SELECT network, count(*) AS n FROM b_located GROUP BY 1",
    "ips": "SELECT network, count(DISTINCT ip) AS n FROM b_located GROUP BY 1",
    "country": "SELECT network, count(DISTINCT (country, country_code)) AS n FROM b_located GROUP BY 1",
    "city": """SELECT network, count(*) AS n FROM (SELECT network, city, country, country_code, lat, lon FROM b_located
               WHERE city <> '' GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1""",
    "hosting": """SELECT network, count(*) AS n FROM (SELECT network, org, hosting FROM b_located
               WHERE org <> '' GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1""",
    "as": """SELECT network, count(*) AS n FROM (SELECT DISTINCT network, asname, as_raw, org FROM b_located
               WHERE asname <> '') GROUP BY 1""",
    "clients": """SELECT network, count(*) AS n FROM (SELECT DISTINCT network, client_name, client_version,
               client_os, client_arch FROM b_listed) GROUP BY 1""",
}
EXPORT_NAMES = {
    "peers": "peer_locations", "ips": "all_ips", "country": "peer_count_by_country",
    "city": "peer_count_by_city", "hosting": "hosting_provider_distribution",
    "as": "peer_count_by_as", "clients": "client_distribution",
}
SMALL10 = "peer_id, ip, port, country, city, lat, lon, isp, org, hosting"

SQL = {
    # scans, sources, sinks
    "scan_peer_info": f"SELECT {PEER_OUT} FROM b_peers",
    "scan_ips": f"SELECT {IPS_OUT} FROM b_ips",
    "scan_conn_events": """SELECT NULL::INT AS id, peer_id, direction, conn_time, latency, disconn_time, identified,
        error FROM b_pairs""",
    "scan_active_peers": """SELECT '2001-08-02 00:00:00.000000' AS timestamp, (id // 65536)::INT AS chunk,
        string_agg(id::VARCHAR, '|' ORDER BY id) AS peers FROM b_active_all GROUP BY 2""",
    "scan_eth_nodes": f"SELECT NULL::INT AS id, {NODE_OUT} FROM b_nodes",
    "scan_eth_status": "SELECT NULL::INT AS id, * FROM b_eth_status",
    "scan_eth_attestations": f"SELECT NULL::INT AS id, * REPLACE ({REAL}) FROM ({ATT_TABLE})",
    "scan_eth_blocks": f"SELECT NULL::INT AS id, * REPLACE ({REAL}) FROM ({BLOCK_TABLE})",
    "ingest_ip_api": f"""SELECT ip, '2001-09-01 00:00:00.000000' AS expiration_time, {GEO_TEXT}
        FROM b_answers WHERE status = 'success'""",
    "located_ips": f"SELECT {IPS_OUT} FROM b_ips WHERE country <> '' OR city <> ''",
    "export_csv": COUNTRY.format("b_located"),
    "network_file_prefix": "SELECT DISTINCT network, replace(lower(network), ' ', '_') || '_' AS prefix FROM b_peers",
    "export_json": f"""SELECT json_object('peer_id', peer_id, 'ip', ip, 'port', port, 'country', country, 'city', city,
        'lat', lat, 'lon', lon, 'isp', isp, 'org', org, 'hosting', hosting)::VARCHAR AS value FROM b_located""",
    "export_geojson": """SELECT peer_id, json_object('type', 'Feature', 'geometry',
        json_object('type', 'Point', 'coordinates', [lon, lat]), 'properties', json_object('peer_id', peer_id,
        'ip', ip, 'country', country, 'city', city, 'isp', isp, 'hosting', hosting))::VARCHAR AS feature FROM b_located""",
    "geojson_document": """SELECT * FROM (WITH f AS (SELECT peer_id, json_object('type', 'Feature', 'geometry',
        json_object('type', 'Point', 'coordinates', [lon, lat]), 'properties', json_object('peer_id', peer_id,
        'ip', ip, 'country', country, 'city', city, 'isp', isp, 'hosting', hosting))::VARCHAR AS feature FROM b_located)
        SELECT feature || CASE WHEN peer_id = (SELECT max(peer_id) FROM f) THEN '' ELSE ',' END AS value FROM f
        UNION ALL SELECT '{"type":"FeatureCollection","features":[' UNION ALL SELECT ']}')""",
    "json_array_document": """SELECT * FROM (WITH f AS (SELECT peer_id, json_object('peer_id', peer_id, 'ip', ip, 'port', port, 'country', country,
        'city', city, 'lat', lat, 'lon', lon, 'isp', isp, 'org', org, 'hosting', hosting)::VARCHAR AS j FROM b_located)
        SELECT j || CASE WHEN peer_id = (SELECT max(peer_id) FROM f) THEN '' ELSE ',' END AS value FROM f
        UNION ALL SELECT '[' UNION ALL SELECT ']')""",
    "attestation_event_json": PUBLISHED,
    "metrics_snapshot": " UNION ALL ".join(crawler_metrics(NET) + node_metrics() + event_metrics()),
    "metric_registry": " UNION ALL ".join(crawler_metrics("true") + node_metrics() + event_metrics()),
    "metrics_tick": " UNION ALL ".join(crawler_metrics(NET) + node_metrics() + event_metrics()),
    # scalar functions
    "ua_client_name": AGENT_BASE.format(NAMED, "client_name"),
    "ua_client_version": f"""SELECT seq, network, user_agent, {client_version('user_agent', 'network', 'n')} AS client_version
        FROM (SELECT *, {NAMED} AS n FROM b_connections)""",
    "ua_version_lotus": AGENT_BASE.format(lotus_version("user_agent"), "client_version"),
    "ua_client_os": AGENT_BASE.format(keywords("user_agent", D.OS_WORDS), "client_os"),
    "ua_client_arch": AGENT_BASE.format(keywords("user_agent", D.ARCH_WORDS), "client_arch"),
    "parse_client": f"""SELECT seq, n AS client_name, {client_version('user_agent', 'network', 'n')} AS client_version,
        {keywords('user_agent', D.OS_WORDS)} AS client_os, {keywords('user_agent', D.ARCH_WORDS)} AS client_arch
        FROM (SELECT *, {NAMED} AS n FROM b_connections)""",
    "is_identified": AGENT_BASE.format("user_agent <> '' OR protocol_version <> '' OR len(protocols) > 0", "identified"),
    "latency_ms": "SELECT seq, (latency_ns // 1000000)::INT AS ms FROM b_connections",
    "classify_dial_error": f"SELECT seq, {error_code('message')} AS error FROM b_dials",
    "delay_class": f"SELECT peer_id, last_error, {delay_class('last_error')} AS delay_class FROM b_peers",
    "maddr_ip": """SELECT seq, address, string_split(address, '/')[3] AS ip
        FROM (SELECT seq, unnest(multi_addrs) AS address FROM b_discoveries)""",
    "maddr_port": """SELECT seq, address, string_split(address, '/')[5]::INT AS port
        FROM (SELECT seq, unnest(multi_addrs) AS address FROM b_discoveries)""",
    "first_public_addr": "SELECT seq, ip, port FROM b_discoveries",
    "direction_name": """SELECT seq, CASE direction WHEN 1 THEN 'inbound' WHEN 2 THEN 'outbound' ELSE 'unset' END AS direction
        FROM b_halves WHERE kind = 'open'""",
    "is_public_ip": f"SELECT ord, ip, public_ AS is_public FROM {ip_checked('SELECT ord, ip FROM b_raw_records')}",
    "is_valid_ip": f"SELECT ord, ip, valid_ AS valid FROM {ip_checked('SELECT ord, ip FROM b_raw_records')}",
    "compose_maddr": "SELECT peer_id, '/ip4/' || ip || '/tcp/' || port AS address FROM b_peers",
    "compose_topic": f"SELECT ord, '/eth2/' || substr(fork_digest, 3) || '/beacon_block/ssz_snappy' AS topic {FORKS}",
    "compose_attnets_topic": f"""SELECT ord, CASE WHEN attnets_number BETWEEN 1 AND 64 THEN '/eth2/' ||
        substr(fork_digest, 3) || '/beacon_attestation_' || attnets_number || '/ssz_snappy' ELSE '' END AS topic {FORKS}""",
    "topic_pretty": "SELECT seq, split_part(topic, '/', 4) AS pretty FROM b_messages",
    "topic_subnet": "SELECT seq, try_cast(regexp_extract(topic, 'attestation_([0-9]+)', 1) AS INT) AS subnet FROM b_messages",
    "valid_fork_digest": f"""SELECT seq, text, CASE text {NAME_TO_DIGEST} ELSE
        CASE WHEN text IN ({', '.join(q(d) for _, d in D.FORK_DIGESTS)}) OR regexp_full_match(text, '[0-9a-fA-F]{{8}}') THEN text END END AS digest
        FROM (SELECT ord AS seq, unnest([eth2, substr(eth2, 1, 10)]) AS text FROM b_raw_records
              UNION ALL SELECT seq, split_part(topic, '/', 3) FROM b_messages)""",
    "genesis_for_digest": f"""SELECT ord, fork_digest, CASE WHEN fork_digest IN ('0x79df0428', '0xc2ce3aa8') THEN 1616508000
        WHEN fork_digest IN ('0xf925ddc5', '0x56fdb5e0') THEN 1638968400 ELSE 1606824023 END::BIGINT AS genesis,
        fork_digest NOT IN ('0xb5303f2a', '0xafcaaba0', '0x4a26c58b', '0x79df0428', '0xc2ce3aa8', '0xf925ddc5', '0x56fdb5e0') AS genesis_defaulted
        {FORKS}""",
    "time_in_slot": "SELECT seq, time_in_slot FROM b_timed",
    "message_id": f"SELECT seq, {MSG_ID} AS msg_id FROM b_messages",
    "attnets_count": "SELECT ord, attnets_number FROM b_records",
    "eth2_data_fields": """SELECT ord, fork_digest, next_fork_version, next_fork_epoch, eth2 IS NOT NULL AS eth2_exists,
        bad AS error FROM b_records""",
    "enr_fork_match": f"SELECT ord, node_id, fork_digest FROM b_records WHERE fork_digest = {q(bridge.DIGESTS[1])}",
    "hex_normalise": """SELECT ord, CASE WHEN length(eth2) = 34 THEN substr(eth2, 3) END AS value,
        CASE WHEN eth2 IS NULL THEN 'missing' WHEN length(eth2) <> 34 THEN 'invalid size' END AS error FROM b_records""",
    # normalisation jobs
    "normalise_peers": f"SELECT peer_id, {stamp('ts')} AS ts, seq, network, {joined('multi_addrs')}, ip, port FROM b_discoveries",
    "normalise_attempts": f"SELECT * REPLACE ({stamp('ts')} AS ts) FROM b_attempts",
    "conn_attempt_from_dial": f"SELECT * EXCLUDE (delay_class) REPLACE ({stamp('ts')} AS ts) FROM b_attempts",
    "normalise_gossip": f"""SELECT {MSG_OUT}, seq, subnet, '' AS val_pubkey, NULL::BIGINT AS val_idx FROM b_attestations
        UNION ALL SELECT {MSG_OUT}, seq, NULL, NULL, val_idx FROM b_blocks""",
    "gossip_to_rows": f"SELECT {MSG_OUT}, seq, subnet, '' AS val_pubkey FROM b_attestations",
    "normalise_records": """SELECT timestamp, ord, peer_id, node_id, seq, ip, tcp, udp, pubkey, attnets, attnets_number,
        fork_digest, next_fork_version, bad AS eth2_error, attnets_error FROM b_records""",
    "topic_handlers": "SELECT seq, topic, reason FROM b_timed WHERE reason IS NOT NULL",
    "identify_events": """
        SELECT 'host' AS "table", peer_id, seq, ip AS detail FROM b_answered
        UNION ALL SELECT 'peer', peer_id, seq, client_version FROM b_identities
        UNION ALL SELECT 'status', peer_id, seq, head_slot::VARCHAR FROM b_status
        UNION ALL SELECT 'metadata', peer_id, seq, attnets FROM b_metadata""",
    # folds
    "fold_host_upsert": """SELECT peer_id, arg_min(network, ts) AS network,
        array_to_string(arg_max(multi_addrs, ts), '|') AS multi_addrs, arg_max(ip, ts) AS ip,
        arg_max(port, ts) AS port, false AS deprecated FROM b_discoveries GROUP BY peer_id""",
    "fold_peer_info": f"""SELECT h.peer_id, i.r.user_agent AS user_agent, i.r.client_name AS client_name,
        i.r.client_version AS client_version, i.r.client_os AS client_os, i.r.client_arch AS client_arch,
        i.r.protocol_version AS protocol_version, array_to_string(i.r.sup_protocols, '|') AS sup_protocols,
        i.r.latency AS latency
        FROM (SELECT peer_id, min(ts) AS born FROM b_discoveries GROUP BY 1) h
        LEFT JOIN ({last_per_peer('b_identities', STATE_COLS['peer'])}) i ON h.peer_id = i.peer_id AND i.at >= h.born""",
    "fold_conn_attempt": """SELECT peer_id, arg_max(status <> 'positive' AND deprecable, ts) AS deprecated, true AS attempted,
        floor(epoch(max(CASE WHEN status = 'positive' THEN ts END)))::BIGINT AS last_activity,
        floor(epoch(max(ts)))::BIGINT AS last_conn_attempt, arg_max(error, ts) AS last_error
        FROM s_live GROUP BY peer_id""",
    "fold_last_activity": "SELECT peer_id, arg_max(disconn_time, ts) AS last_activity FROM b_pairs GROUP BY 1",
    "fold_peer_state": peer_state("s"),
    "fold_ips": f"""SELECT ip, {stamp('expiration_time')} AS expiration_time, {GEO_TEXT.replace('isp,', "CASE WHEN hosting THEN isp || ' (new)' ELSE isp END AS isp,")}
        FROM b_ips""",
    "fold_eth_nodes": f"SELECT {NODE_OUT} FROM b_nodes",
    "fold_eth_nodes_by_seq": """
        SELECT o.peer_id, o.pubkey, o.node_id, x.timestamp, x.seq, x.ip, x.tcp, x.udp, x.fork_digest,
               x.next_fork_version, x.attnets, x.attnets_number
        FROM b_nodes o JOIN (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq DESC, ord DESC) AS rn
                             FROM b_records) x ON o.node_id = x.node_id AND x.rn = 1""",
    "dq_eth_node_conflicts": """SELECT node_id, k.peer_id AS peer_id, k.pubkey AS pubkey, owner FROM b_node_rank WHERE rn > 1""",
    "fold_eth_status": "SELECT * FROM b_eth_status",
    "active_peers_snapshot": """SELECT '2001-08-02 00:00:00.000000' AS timestamp, (id // 65536)::INT AS chunk,
        string_agg(id::VARCHAR, '|' ORDER BY id) AS peers FROM b_active_all GROUP BY 2""",
    "insert_attestations": ATT_TABLE,
    "insert_blocks": BLOCK_TABLE,
    "append_conn_events": "SELECT peer_id, direction, conn_time, latency, disconn_time, identified, error FROM b_pairs",
    "snapshot_explode": """SELECT '2001-08-02 00:00:00.000000' AS timestamp, id::BIGINT AS id, peer_id, network, client_name
        FROM b_active_all""",
    # lookups
    "full_host_info": f"""SELECT {PEER_OUT.replace('latency,', 'latency::BIGINT * 1000000 AS latency_ns,')
        .replace('last_activity,', stamp('to_timestamp(last_activity) AT TIME ZONE ' + q('UTC')) + ' AS last_activity,')
        .replace('last_conn_attempt,', stamp('to_timestamp(last_conn_attempt) AT TIME ZONE ' + q('UTC')) + ' AS last_conn_attempt,')}
        FROM b_peers WHERE peer_id = {q(SHOWN_PEER)}""",
    "persistable_peer": f"SELECT peer_id, network, {joined('multi_addrs')} FROM b_peers WHERE peer_id = {q(SHOWN_PEER)}",
    "peer_exists": """SELECT DISTINCT peer_id, peer_id IN (SELECT peer_id FROM b_discoveries) AS peer_exists FROM b_events""",
    "connectable_peers": f"SELECT peer_id, network, {joined('multi_addrs')} FROM b_listed WHERE {NET}",
    "ip_info": f"SELECT {IPS_OUT} FROM b_ips WHERE ip = {q(SHOWN_IP)}",
    "expired_ips": "SELECT ip FROM b_ips WHERE expiration_time < TIMESTAMP '2001-08-02'",
    "ip_record_status": """SELECT p.ip, i.ip IS NOT NULL AS record_exists,
        coalesce(i.expiration_time < TIMESTAMP '2001-08-02', false) AS record_expired
        FROM (SELECT DISTINCT ip FROM b_peers) p LEFT JOIN b_ips i ON p.ip = i.ip""",
    "ips_to_locate": """SELECT ip FROM (SELECT DISTINCT ip FROM b_peers)
        WHERE ip NOT IN (SELECT ip FROM b_ips WHERE expiration_time >= TIMESTAMP '2001-08-02')""",
    "networks": "SELECT DISTINCT network FROM b_listed ORDER BY 1",
    "discovered_valid_nodes": "SELECT peer_id, seq, node_ip, node_tcp FROM b_discoveries WHERE node_tcp <> 0 AND node_ip IS NOT NULL",
    "discovered_dedup": """SELECT peer_id, min(seq) AS seq, array_to_string(arg_min(multi_addrs, ts), '|') AS multi_addrs
        FROM b_discoveries GROUP BY peer_id""",
    "public_discoveries": "SELECT seq, ip, ip <> '' AS is_public FROM b_discoveries",
    # distributions
    "client_distribution": f"SELECT client_name, count(*) AS cnt FROM b_active WHERE {NET} GROUP BY 1",
    "version_distribution": f"""SELECT client_name, client_version, client_name || '_' || client_version AS label, count(*) AS cnt
        FROM b_active WHERE {NET} GROUP BY 1, 2""",
    "geo_distribution": f"""SELECT country_code, count(*) AS cnt FROM b_active p JOIN b_ips i ON p.ip = i.ip WHERE {NET} GROUP BY 1""",
    "os_distribution": f"SELECT client_os, count(client_os) AS cnt FROM b_active WHERE {NET} GROUP BY 1",
    "arch_distribution": f"SELECT client_arch, count(client_arch) AS cnt FROM b_active WHERE {NET} GROUP BY 1",
    "hosting_distribution": " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, count(*) AS cnt FROM b_active p JOIN b_ips i ON p.ip = i.ip WHERE {NET} AND {flag}"
        for kind, flag in (("mobile_ips", "mobile"), ("under_proxy", "proxy"), ("hosted_ips", "hosting"))
    ),
    "rtt_distribution": f"SELECT {RTT} AS latency_range, count(*) AS nodes FROM b_seen WHERE {NET} GROUP BY 1",
    "ip_distribution": f"""SELECT n AS nodes_per_ip, count(*) AS number_of_ips
        FROM (SELECT ip, count(*) AS n FROM b_seen WHERE {NET} GROUP BY 1) GROUP BY 1""",
    "fork_distribution": "SELECT fork_digest, count(*) AS cnt FROM b_recent_nodes GROUP BY 1",
    "attnets_distribution": "SELECT attnets_number, count(attnets_number) AS cnt FROM b_recent_nodes GROUP BY 1",
    "deprecated_count": f"SELECT count(*) AS cnt FROM b_peers WHERE deprecated AND {NET}",
    "node_distribution": f"SELECT count(*) AS cnt FROM b_listed WHERE {NET}",
    "delay_distribution": "SELECT delay_class, count(*) AS cnt FROM r_state WHERE NOT deprecable GROUP BY 1",
    "total_error_distribution": "SELECT last_error AS error, count(*) AS cnt FROM r_state WHERE NOT deprecable GROUP BY 1",
    "iteration_delay_distribution": f"SELECT delay_class, count(*) AS cnt FROM r_state WHERE {LAST_DAY} GROUP BY 1",
    "iteration_error_distribution": f"SELECT last_error AS error, count(*) AS cnt FROM r_state WHERE {LAST_DAY} GROUP BY 1",
    "iteration_attempts": f"SELECT count(*) AS cnt FROM r_state WHERE {LAST_DAY}",
    "iteration_time": """SELECT epoch(date_trunc('day', ts))::BIGINT AS iteration_start,
        (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE AS seconds FROM b_attempts GROUP BY 1""",
    "presence_intervals": f"""SELECT id, {stamp('min(day)')} AS present_from, {stamp('max(day)')} AS present_to, count(*) AS snapshots
        FROM (SELECT *, tick - row_number() OVER (PARTITION BY id ORDER BY tick) AS run FROM b_present) GROUP BY id, run""",
    "network_at": f"""SELECT {stamp('day')} AS timestamp, id, peer_id, network FROM b_present
        WHERE day = (SELECT max(day) FROM b_present WHERE day <= TIMESTAMP '2001-09-20 12:00:00')""",
    "sender_sketches": """SELECT strftime(arrival_time, '%Y-%m-%d') AS day, topic, count(DISTINCT sender) AS exact, true AS close
        FROM b_messages GROUP BY 1, 2""",
    "dial_passes": f"SELECT {PASS_OUT} FROM b_passes",
    "last_pass": f"SELECT {PASS_OUT} FROM b_last_pass",
    "last_pass_delay_distribution": f"SELECT delay_class, count(*) AS cnt FROM r_state WHERE {IN_LAST_PASS} GROUP BY 1",
    "last_pass_error_distribution": f"SELECT last_error AS error, count(*) AS cnt FROM r_state WHERE {IN_LAST_PASS} GROUP BY 1",
    "connected_peers": "SELECT count(*) AS cnt FROM " + CONNECTED.format("2024-01-31 00:00:00"),
    "peers_per_topic": "SELECT topic, count(DISTINCT sender) AS peers FROM b_messages GROUP BY 1",
    "messages_per_topic": "SELECT * FROM b_rates",
    "messages_total": """SELECT window_start, sum(cnt)::BIGINT AS cnt, sum(per_minute) AS per_minute FROM b_rates GROUP BY 1""",
    "head_slot": f"""SELECT peer_id, {stamp('ts')} AS ts, seq, {', '.join(STATUS_FIELDS)} FROM b_status
        ORDER BY head_slot DESC, b_status.ts, seq LIMIT 1""",
    "supported_protocols": f"""SELECT protocol, count(*) AS cnt
        FROM (SELECT unnest(sup_protocols) AS protocol FROM b_peers WHERE {NET}) GROUP BY 1""",
    # reports
    "peer_locations": f"SELECT {LOCATION} FROM b_located ORDER BY network, country, city",
    "all_ips": """SELECT DISTINCT i.ip, i.country, i.country_code, i.city, i.region_name, i.lat, i.lon, i.isp, i.org,
        i.as_raw, i.asname, i.hosting, i.proxy, i.mobile FROM b_ips i JOIN b_listed p ON i.ip = p.ip""",
    "country_stats": COUNTRY.format("b_located"),
    "city_stats": """SELECT city, country, country_code, count(DISTINCT peer_id) AS peer_count, lat, lon FROM b_located
        WHERE city <> '' GROUP BY city, country, country_code, lat, lon HAVING count(*) >= 2""",
    "hosting_stats": """SELECT org AS provider, count(DISTINCT peer_id) AS peer_count, count(DISTINCT country) AS countries, hosting
        FROM b_located WHERE org <> '' GROUP BY org, hosting HAVING count(*) >= 2""",
    "as_stats": f"""SELECT asname, as_raw, org, count(DISTINCT peer_id) AS peer_count, count(DISTINCT country) AS countries, {HOSTED}
        FROM b_located WHERE asname <> '' GROUP BY asname, as_raw, org""",
    "client_stats": """SELECT client_name, client_version, client_os, client_arch, count(*) AS peer_count,
        round((100 * count(*))::DECIMAL(18,6) / (SELECT count(*) FROM b_listed), 2)::DOUBLE AS percentage
        FROM b_listed GROUP BY 1, 2, 3, 4""",
    "country_top": "SELECT country, country_code, count(DISTINCT peer_id) AS peer_count FROM b_located GROUP BY 1, 2",
    "city_top50": """SELECT country, city, count(DISTINCT peer_id) AS peer_count FROM b_located GROUP BY 1, 2
        ORDER BY peer_count DESC, country, city LIMIT 50""",
    "hosting_top20": """SELECT org, hosting, count(DISTINCT peer_id) AS peer_count FROM b_located WHERE hosting GROUP BY 1, 2
        ORDER BY peer_count DESC, org LIMIT 20""",
    "network_locations_outer": """SELECT peer_id, p.ip, port, user_agent, client_name, client_version, country, country_code, city,
        lat, lon, isp, org, asname, hosting FROM b_listed p LEFT JOIN b_ips i ON p.ip = i.ip WHERE network = 'Polygon'""",
    "peer_locations_small_10": f"SELECT {SMALL10} FROM b_located",
    "peer_locations_small_7": "SELECT peer_id, ip, port, country, city, lat, lon FROM b_located",
    "export_all": " UNION ALL ".join(
        f"SELECT replace(lower(network), ' ', '_') || '_{EXPORT_NAMES[key]}.csv' AS file, n FROM ({sql}) WHERE n > 0"
        for key, sql in EXPORT_ROWS.items()
    ),
    # audit
    "peers_by_network": "SELECT network, count(*) AS peers, count(DISTINCT ip) AS unique_ips FROM b_listed GROUP BY ROLLUP (network)",
    "contamination": "SELECT network, client_name, count(*) AS cnt FROM b_peers WHERE client_name IS NOT NULL AND NOT CASE network "
    + " ".join(
        f"WHEN {q(n)} THEN client_name NOT IN ({', '.join(q(c) for m in D.NETWORKS if m != n for c, _ in D.CLIENT_WORDS[m])})"
        for n in D.NETWORKS
    )
    + " END GROUP BY 1, 2",
    "ip_overlap": "SELECT * FROM b_overlap",
    "ip_overlap_share": """SELECT network_a, network_b, shared_ips, round(100.0::DOUBLE * shared_ips / a.n, 2) AS pct_a,
        round(100.0::DOUBLE * shared_ips / b.n, 2) AS pct_b
        FROM b_overlap JOIN b_ip_sizes a ON network_a = a.network JOIN b_ip_sizes b ON network_b = b.network""",
    "geo_coverage": """SELECT network, count(*) AS unique_ips, count(i.ip) AS located_ips,
        round(100.0::DOUBLE * count(i.ip) / count(*), 1) AS coverage
        FROM b_pairs_ip p LEFT JOIN b_ips i ON p.ip = i.ip GROUP BY network""",
    "activity_range": COUNTRY.format(
        "b_located"
    ).replace(
        "FROM b_located",
        "FROM b_located WHERE last_activity >= epoch(TIMESTAMP '2001-06-01')::BIGINT AND last_activity < epoch(TIMESTAMP '2001-08-02')::BIGINT",
    ),
    "networks_all_counts": "SELECT network, count(*) AS peers FROM b_peers GROUP BY 1",
    # state and graph
    "pair_conn_events": "SELECT seq, peer_id, direction, conn_time, latency, disconn_time, identified, error FROM b_pairs",
    "peer_retry_state": state_out("r"),
    "retry_history": state_out("s", "history"),
    "delay_policy": state_out("c"),
    "deprecate_peers": f"""SELECT peer_id, life::INT AS life, {stamp('start_ts')} AS life_start, {stamp('end_ts')} AS deprecated_at
        FROM s_lives WHERE end_ts IS NOT NULL""",
    "ready_queue": f"""SELECT peer_id, {stamp('next_attempt')} AS next_attempt, delay_class, last_error FROM r_state
        WHERE NOT deprecable AND (next_attempt IS NULL OR next_attempt <= TIMESTAMP '2024-01-31')""",
    "neighbour_edges": "SELECT peer, neighbour FROM b_edges",
    "neighbour_errors": """SELECT peer, bit_or(CASE WHEN failed THEN 1 << cpl ELSE 0 END)::INT AS error_bits FROM b_probes GROUP BY 1""",
    "crawl_frontier": " UNION ALL ".join(f"SELECT peer, {i} AS round FROM g_{i}" for i in range(7)),
    # streams: the batch form of the same data
    "gossip_stream": f"SELECT {MSG_OUT}, seq, val_idx FROM b_blocks",
    "timed_attestations": PUBLISHED,
    "published_batches": PUBLISHED,
    "dedup_table": "SELECT DISTINCT msg_id FROM b_attestations WHERE slot <> 0",
    "dedup_gossip": "SELECT DISTINCT msg_id FROM b_attestations WHERE slot <> 0",
    "message_rates": """SELECT * FROM b_rates WHERE (window_start + 15) * 1000 <=
        (SELECT epoch_ms(max(arrival_time)) - 60000 FROM b_messages)""",
    "pair_conn_stream": "SELECT seq, peer_id, direction, conn_time, latency, disconn_time, identified, error FROM b_pairs",
    "fold_stream": peer_state("s"),
    "retry_state_stream": state_out("s"),
    # A turn comes out unless another attempt overtakes it, up to the last event.
    "due_stream": f"""SELECT peer_id, life, {stamp('due')} AS due, cls AS delay_class, degree FROM s_turns
        WHERE NOT coalesce(ends, false) AND (after >= due OR (after IS NULL AND epoch_ms(due) <= (SELECT epoch_ms(max(ts)) FROM
            (SELECT ts FROM b_attempts UNION ALL SELECT ts FROM b_discoveries))))""",
    "snapshot_tick": """SELECT '2001-08-02 00:00:00.000000' AS timestamp, (id // 65536)::INT AS chunk,
        string_agg(id::VARCHAR, '|' ORDER BY id) AS peers FROM b_active_all GROUP BY 2""",
}
_DAYS = ", ".join(f"(TIMESTAMP '{d}')" for d in ("2001-06-03", "2001-07-03", "2001-08-02", "2001-09-01", "2001-10-01", "2001-12-30"))
VIEWS["b_present"] = f"""SELECT day, id::BIGINT AS id, peer_id, network, dense_rank() OVER (ORDER BY day) AS tick
    FROM b_peers JOIN (VALUES {_DAYS}) AS t(day) ON last_activity > epoch(day)::BIGINT - 180 * 86400
    WHERE NOT deprecated AND attempted AND client_name IS NOT NULL"""
VIEWS["b_active_all"] = "SELECT * FROM b_active"
# A table folded from a stream is the table folded in batch.
SQL |= {
    f"fold_stream_{name}": SQL[batch] for name, batch in {
        "status": "fold_eth_status", "attestations": "insert_attestations", "blocks": "insert_blocks", "ips": "fold_ips",
        "nodes": "fold_eth_nodes",
    }.items()
}

# Views that are computed first: DuckDB 2.0.0 now and then stops with an internal
# error when the inner side of a join is itself a join over a DISTINCT.
MATERIALIZED = {"b_answers"}
_NAME = re.compile(r"\b([a-z]+_[a-z0-9_]+)\b")


def with_views(body):
    """Prefix a query with the views it uses, each after those it needs."""
    order = []

    def need(sql, path):
        for name in dict.fromkeys(_NAME.findall(sql)):
            if name in VIEWS and name not in order and name not in path:
                need(VIEWS[name], path | {name})
                order.append(name)

    need(body, frozenset())
    if not order:
        return body
    views = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({VIEWS[name]})" for name in order
    )
    return f"WITH RECURSIVE {views}\n{body}"


def oracle_sql():
    return {name: with_views(body) for name, body in SQL.items()}


__all__ = ["oracle_sql", "DIGESTS"]
