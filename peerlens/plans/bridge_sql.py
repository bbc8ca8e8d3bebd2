"""The bridged tables and event logs as SQL views, for the cross-check.

Written against the plain test tables, independently of the DataFrame code;
only fixed values (word lists, codes, agents) are shared.
"""

from peerlens import domains as D
from peerlens.sources import bridge


def q(text):
    return "'" + str(text).replace("'", "''") + "'"


def array(values):
    return "[" + ", ".join(q(v) for v in values) + "]"


def stamp(expression):
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def keywords(text, table, default=D.UNKNOWN):
    """CASE over a word table; the first row with a contained word wins."""
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), {q(w)})" for w in words) + f" THEN {q(name)}"
        for name, words in table
    )
    return f"CASE {arms} ELSE {q(default)} END"


def by_network(network, build, otherwise):
    arms = " ".join(f"WHEN {q(n)} THEN {build(n)}" for n in D.NETWORKS)
    return f"CASE {network} {arms} ELSE {otherwise} END"


def client_name(agent, network):
    head = f"split_part({agent}, '/', 1)"
    return by_network(network, lambda n: keywords(head, D.CLIENT_WORDS[n]), "''")


def lotus_version(agent):
    return f"coalesce(string_split(split_part(split_part({agent}, '/', 1), '+', 1), '-')[2], 'unknown')"


def client_version(agent, network, name):
    piece = f"coalesce(string_split({agent}, '/')[CASE WHEN {name} = 'teku' THEN 3 ELSE 2 END], 'unknown')"
    return (
        f"CASE WHEN {name} = '' THEN '' WHEN {name} IN ('unknown', 'punchr') THEN 'unknown' "
        f"WHEN {network} = 'Filecoin' THEN {lotus_version(agent)} "
        f"ELSE split_part(split_part({piece}, '+', 1), '-', 1) END"
    )


def agent(network, index):
    return by_network(
        network,
        lambda n: f"({array(bridge.AGENTS[n])})[({index}) % {len(bridge.AGENTS[n])} + 1]",
        "NULL",
    )


def error_code(message):
    arms = " ".join(f"WHEN contains({message}, {q(f)}) THEN {q(c)}" for c, f in D.ERROR_FRAGMENTS)
    return f"CASE WHEN {message} IS NULL THEN 'none' {arms} ELSE 'unknown' END"


def delay_class(code, classes=D.DELAY_CLASS_ERRORS):
    arms = " ".join(
        f"WHEN {code} IN ({', '.join(q(e) for e in errors)}) THEN {q(name)}" for name, errors in classes
    )
    return f"CASE {arms} ELSE 'NegativeWithHope' END"


def _octets(text):
    """The four numbers of a dotted text, or NULL: plain decimal arithmetic, no pattern for the ranges."""
    parts = f"string_split({text}, '.')"
    good = f"list_bool_and(list_transform({parts}, lambda x: coalesce(try_cast(x AS INT)::VARCHAR = x AND try_cast(x AS INT) BETWEEN 0 AND 255, false)))"
    return f"CASE WHEN len({parts}) = 4 AND {good} THEN list_transform({parts}, lambda x: x::INT) END"


def _private(o):
    return (
        f"({o}[1] IN (10, 127) OR ({o}[1] = 192 AND {o}[2] = 168) OR ({o}[1] = 172 AND {o}[2] BETWEEN 16 AND 31) "
        f"OR list_sum({o}) = 0)"
    )


def ip_checked(source):
    """`source` (with a column ip) with columns valid and is_public, worked out from numbers in a few steps."""
    return f"""(
        SELECT * EXCLUDE (colon, tail, o4, swapped, pieces, holes, g, ok, gap, n6), coalesce(o4 IS NOT NULL OR n6 IS NOT NULL, false) AS valid_,
               coalesce(CASE WHEN o4 IS NOT NULL THEN NOT {_private('o4')}
                   WHEN n6 IS NOT NULL THEN NOT (list_sum(n6[1:7]) = 0 AND n6[8] <= 1)
                        AND NOT (list_sum(n6[1:5]) = 0 AND n6[6] = 65535 AND {_private('[n6[7] // 256, n6[7] % 256, n6[8] // 256, n6[8] % 256]')})
                   END, false) AS public_
        FROM (SELECT *, CASE WHEN ok AND gap THEN list_concat(g[1:holes], list_concat(list_transform(range(8 - len(g)), lambda z: 0::BIGINT), g[holes + 1:]))
                             WHEN ok AND NOT gap AND len(g) = 8 THEN g END AS n6
        FROM (SELECT *, contains(swapped, '::') AS gap,
                     len(list_filter(string_split(split_part(swapped, '::', 1), ':'), lambda x: x <> '')) AS holes,
                     list_transform(list_filter(pieces, lambda x: x <> ''), lambda x: try_cast('0x' || CASE WHEN length(x) <= 4 AND NOT contains(lower(x), 'x') THEN x END AS BIGINT)) AS g,
                     colon AND len(string_split(swapped, '::')) <= 2 AND NOT contains(swapped, ':::')
                     AND (starts_with(swapped, '::') OR NOT starts_with(swapped, ':')) AND (ends_with(swapped, '::') OR NOT ends_with(swapped, ':'))
                     AND NOT list_contains(list_transform(list_filter(pieces, lambda x: x <> ''), lambda x: try_cast('0x' || CASE WHEN length(x) <= 4 AND NOT contains(lower(x), 'x') THEN x END AS BIGINT) IS NULL), true)
                     AND len(list_filter(pieces, lambda x: x <> '')) <= CASE WHEN contains(swapped, '::') THEN 7 ELSE 8 END AS ok
        FROM (SELECT *, string_split(swapped, ':') AS pieces
        FROM (SELECT *, CASE WHEN colon AND {_octets('tail')} IS NOT NULL THEN substr(ip, 1, length(ip) - length(tail))
                        || printf('%x:%x', ({_octets('tail')})[1] * 256 + ({_octets('tail')})[2], ({_octets('tail')})[3] * 256 + ({_octets('tail')})[4]) ELSE ip END AS swapped,
                     CASE WHEN NOT colon THEN {_octets('ip')} END AS o4
        FROM (SELECT *, contains(ip, ':') AS colon, string_split(ip, ':')[-1] AS tail FROM ({source}))))))
    )"""


def attnets_bits(column):
    """Bits of the bytes that the text decodes to; texts that decode to none give -1, undecodable ones NULL."""
    h = f"regexp_replace({column}, '^0x', '')"
    decoded = f"list_sum(list_transform(range(1, length({h}) + 1, 2), lambda i: bit_count(('0x' || substr({h}, i::INT, 2))::INT)))::INTEGER"
    good = f"regexp_full_match({h}, '([0-9a-fA-F]{{2}})+')"
    return f"CASE WHEN {column} IS NULL OR {h} = '' THEN -1 WHEN {good} THEN {decoded} END"


MSG_ID = (
    "replace(replace(to_base64(unhex(sha256(payload))), '+', '-'), '/', '_')"
)
NETS = array(D.NETWORKS)
FRAGMENTS = array([f for _, f in D.ERROR_FRAGMENTS] + ["something else"])
PROTOCOLS = array(bridge.PROTOCOLS)
DIGESTS = array(bridge.DIGESTS)
SLOT = f"((epoch_us(ts) // 1000000 - {D.MAINNET_GENESIS}) // {D.SECONDS_PER_SLOT})"
_PARSED = "pn"

VIEWS = {
    "b_last_order": "SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1",
    "b_peer_base": f"""
        SELECT c_custkey AS k, c_name, c_nationkey, c_acctbal,
               ({NETS})[c_custkey % 5 + 1] AS pn,
               ({NETS})[(c_custkey + (c_custkey % 29 = 7)::INT) % 5 + 1] AS network,
               '52.' || c_nationkey || '.0.' || (c_custkey % 37) AS ip,
               (9000 + c_custkey % 7)::INT AS port,
               CASE WHEN c_custkey % 11 <> 0 THEN epoch(d)::BIGINT END AS last_activity
        FROM customer LEFT JOIN b_last_order ON c_custkey = o_custkey""",
    "b_peer_agent": f"""
        SELECT *, CASE WHEN k % 13 <> 0 THEN {agent('pn', 'k % 12')} END AS user_agent
        FROM b_peer_base""",
    "b_peer_named": f"""
        SELECT *, CASE WHEN user_agent IS NOT NULL THEN {client_name('user_agent', 'pn')} END AS client_name
        FROM b_peer_agent""",
    "b_peers": f"""
        SELECT k::INT AS id, c_name AS peer_id, network,
               ['/ip4/10.0.0.1/tcp/1', '/ip4/' || ip || '/tcp/' || port] AS multi_addrs,
               ip, port, user_agent, client_name,
               CASE WHEN user_agent IS NOT NULL THEN {client_version('user_agent', 'pn', 'client_name')} END AS client_version,
               CASE WHEN user_agent IS NOT NULL THEN {keywords('user_agent', D.OS_WORDS)} END AS client_os,
               CASE WHEN user_agent IS NOT NULL THEN {keywords('user_agent', D.ARCH_WORDS)} END AS client_arch,
               CASE WHEN user_agent IS NOT NULL THEN 'eth2/1.0.0' END AS protocol_version,
               ({PROTOCOLS})[1:(1 + k % 4)] AS sup_protocols,
               CASE WHEN k % 23 <> 0 THEN (floor(abs(c_acctbal))::BIGINT % 1200)::INT END AS latency,
               c_acctbal < 0 AS deprecated,
               CASE WHEN k % 9 <> 0 THEN true END AS attempted,
               last_activity, last_activity + 60 AS last_conn_attempt,
               ({array(D.ERROR_CODES)})[k % 29 + 1] AS last_error
        FROM b_peer_named""",
    "b_listed": "SELECT * FROM b_peers WHERE NOT deprecated",
    "b_seen": """
        SELECT * FROM b_peers WHERE NOT deprecated AND client_name IS NOT NULL
          AND last_activity > epoch(TIMESTAMP '2001-08-02 00:00:00')::BIGINT - 180 * 86400""",
    "b_active": "SELECT * FROM b_seen WHERE attempted",
    "b_answers": f"""
        SELECT (nk * 37 + host)::INT AS id, '52.' || nk || '.0.' || host AS ip,
               CASE WHEN host < 33 THEN 'success' ELSE 'fail' END AS status,
               TIMESTAMP '2001-08-02 00:00:00' + to_days((nk - 12)::INT) AS expiration_time,
               r_name AS continent, 'R' || r_regionkey AS continent_code,
               CASE WHEN host = 32 THEN '' ELSE n_name END AS country,
               'C' || nk AS country_code, (nk % 4)::VARCHAR AS region,
               n_name || ' area' AS region_name,
               CASE WHEN host = 32 OR nk % 6 = 0 THEN '' ELSE n_name END AS city, '' AS zip,
               (nk - 12.25)::DOUBLE AS lat, (nk * 2 + 0.5)::DOUBLE AS lon,
               'ISP' || (nk % 8) AS isp,
               CASE WHEN nk % 8 = 0 THEN '' ELSE 'AS' || (nk % 8) END AS org,
               'AS6450' || (nk % 8) || ' raw' AS as_raw,
               CASE WHEN nk % 8 = 0 THEN '' ELSE 'AS' || (nk % 8) END AS asname,
               nk % 7 = 0 AS mobile, nk % 5 = 0 AS proxy, nk % 3 = 0 AS hosting
        FROM (SELECT DISTINCT c_nationkey AS nk, c_custkey % 37 AS host FROM customer)
        JOIN nation ON nk = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "b_ips": "SELECT * EXCLUDE (status) FROM b_answers WHERE status = 'success'",
    "b_located": "SELECT p.*, i.* EXCLUDE (id, ip) FROM b_listed p JOIN b_ips i ON p.ip = i.ip",
    # ------------------------------------------------------------ event logs
    "b_events": """
        SELECT 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS peer_id, ts, event_id AS seq,
               user_id AS u, event_id AS e, event_type, value, props FROM events""",
    "b_halves": """
        SELECT peer_id, CASE event_type WHEN 'view' THEN 'open' ELSE 'close' END AS kind, ts, seq,
               CASE WHEN event_type = 'view' THEN (e % 3)::INT END AS direction,
               CASE WHEN event_type = 'view' THEN round(value * 1000000)::BIGINT END AS latency_ns,
               CASE WHEN event_type = 'view' THEN e % 6 <> 0 END AS identified,
               CASE WHEN event_type = 'view' THEN
                    CASE WHEN e % 6 <> 0 THEN 'None' ELSE 'error requesting metadata' END END AS error
        FROM b_events WHERE event_type IN ('view', 'click')""",
    "b_dials": f"""
        SELECT peer_id, ts, seq,
               CASE WHEN event_type = 'error' THEN 'dial failed: ' || ({FRAGMENTS})[e % {len(D.ERROR_FRAGMENTS) + 1} + 1] END AS message
        FROM b_events WHERE event_type IN ('purchase', 'error')""",
    "b_attempts": f"""
        SELECT peer_id, ts, seq,
               CASE WHEN message IS NULL THEN 'positive' ELSE 'negative' END AS status,
               {error_code('message')} AS error,
               {delay_class(error_code('message'))} AS delay_class
        FROM b_dials""",
    "b_discoveries": f"""
        SELECT peer_id, ts, seq, ({NETS})[(u + (e % 11 = 0)::INT) % 5 + 1] AS network,
               CASE WHEN e % 19 = 0 THEN ['/ip4/10.0.0.1/tcp/1']
                    ELSE ['/ip4/10.0.0.1/tcp/1', '/ip4/52.' || (u % 25) || '.0.' || (e % 37) || '/tcp/' || (9000 + e % 7)] END AS multi_addrs,
               CASE WHEN e % 31 <> 0 THEN '52.0.0.' || (e % 37) END AS node_ip,
               CASE WHEN e % 17 = 0 THEN 0 ELSE 9000 + e % 7 END::INT AS node_tcp,
               CASE WHEN e % 19 = 0 THEN '' ELSE '52.' || (u % 25) || '.0.' || (e % 37) END AS ip,
               CASE WHEN e % 19 = 0 THEN 0 ELSE 9000 + e % 7 END::INT AS port
        FROM b_events WHERE event_type = 'signup'""",
    "b_conn_base": f"""
        SELECT *, ({NETS})[u % 5 + 1] AS network, md5(e::VARCHAR) AS h,
               {SLOT} AS now_slot
        FROM b_events WHERE event_type = 'view'""",
    "b_connections": f"""
        SELECT peer_id, ts, seq, e, network, h,
               '52.' || (u % 25) || '.0.' || (e % 37) AS ip, (9000 + e % 7)::INT AS port,
               CASE WHEN e % 6 = 0 THEN 'context deadline exceeded' END AS identify_error,
               CASE WHEN e % 13 = 0 THEN '' ELSE {agent('network', 'e % 12')} END AS user_agent,
               CASE WHEN e % 13 = 0 THEN '' ELSE 'eth2/1.0.0' END AS protocol_version,
               CASE WHEN e % 13 = 0 THEN [] ELSE ({PROTOCOLS})[1:(1 + e % 4)] END AS protocols,
               round(value * 1000000)::BIGINT AS latency_ns,
               CASE WHEN e % 4 <> 0 THEN ({DIGESTS})[u % 4 + 1] END AS fork_digest,
               CASE WHEN e % 4 <> 0 THEN h END AS finalized_root,
               CASE WHEN e % 4 <> 0 THEN now_slot // 32 - 2 END AS finalized_epoch,
               CASE WHEN e % 4 <> 0 THEN md5(h) END AS head_root,
               CASE WHEN e % 4 <> 0 THEN now_slot - e % 3 END AS head_slot,
               CASE WHEN e % 3 <> 0 THEN e % 100 END AS seq_number,
               CASE WHEN e % 3 <> 0 THEN substr(h, 1, 16) END AS attnets,
               CASE WHEN e % 3 <> 0 THEN substr(h, 17, 2) END AS syncnets
        FROM b_conn_base""",
    "b_answered": "SELECT * FROM b_connections WHERE identify_error IS NULL",
    "b_ident_named": f"""
        SELECT *, {client_name('user_agent', 'network')} AS client_name FROM b_answered
        WHERE user_agent <> '' OR protocol_version <> '' OR len(protocols) > 0""",
    "b_identities": f"""
        SELECT peer_id, ts, seq, user_agent, client_name,
               {client_version('user_agent', 'network', 'client_name')} AS client_version,
               {keywords('user_agent', D.OS_WORDS)} AS client_os,
               {keywords('user_agent', D.ARCH_WORDS)} AS client_arch,
               protocol_version, protocols AS sup_protocols, (latency_ns // 1000000)::INT AS latency
        FROM b_ident_named""",
    "b_status": f"SELECT * FROM b_answered WHERE network = 'Ethereum CL' AND e % 4 <> 0",
    "b_metadata": f"SELECT * FROM b_answered WHERE network = 'Ethereum CL' AND e % 3 <> 0",
    "b_messages": f"""
        SELECT peer_id AS sender,
               '/eth2/{bridge.DIGEST[2:]}/' || CASE WHEN e % 3 = 0 THEN 'beacon_attestation_' ||
                   CASE WHEN e % 7 = 0 THEN 'x' ELSE (1 + (e // 3) % 64)::VARCHAR END
                 WHEN e % 3 = 1 THEN 'beacon_block' ELSE 'voluntary_exit' END || '/ssz_snappy' AS topic,
               props AS payload, CASE WHEN e % 50 = 0 THEN 0 ELSE {SLOT} - e % 2 END AS slot,
               e % 1000 AS proposer, ts AS arrival_time, seq, e
        FROM b_events WHERE event_type IN ('purchase', 'signup')""",
    "b_timed": f"""
        SELECT *, {MSG_ID} AS msg_id,
               (epoch_us(arrival_time) - ({D.MAINNET_GENESIS} + slot * {D.SECONDS_PER_SLOT}) * 1000000) / 1000000.0::DOUBLE AS time_in_slot,
               CASE WHEN sender = '{bridge.SELF_ID}' THEN 'own message'
                    WHEN e % 3 = 2 THEN 'no handler'
                    WHEN e % 3 = 0 AND e % 7 = 0 THEN 'no subnet in topic' END AS reason
        FROM b_messages""",
    "b_attestations": """
        SELECT *, try_cast(regexp_extract(topic, 'attestation_([0-9]+)', 1) AS INT) AS subnet
        FROM b_timed WHERE reason IS NULL AND e % 3 = 0""",
    "b_blocks": "SELECT *, proposer AS val_idx FROM b_timed WHERE reason IS NULL AND e % 3 = 1",
    # ------------------------------------------------------------ node records
    "b_raw_records": f"""
        SELECT epoch(TIMESTAMP '2001-08-02 00:00:00')::BIGINT - (p % 48) * 3600 AS timestamp, p AS ord,
               CASE WHEN node % 41 <> 3 THEN 'P' || (node // 2) END AS peer_id, md5(node::VARCHAR) AS node_id, p_size::BIGINT AS seq,
               CASE p % 31 WHEN 0 THEN '0::1' WHEN 1 THEN '::0' WHEN 2 THEN '::0001' WHEN 3 THEN '::ffff:a00:1'
                    WHEN 4 THEN '0:0:0:0:0:ffff:10.0.0.1' WHEN 5 THEN '2001:db8::' || (p % 10000)
                    WHEN 6 THEN 'fe80::' || (p % 10000) WHEN 7 THEN '1:2:3:4:5::1:2:3:4:1.2.3.4'
                    WHEN 8 THEN '10.' || (p % 256) || '.0.1' WHEN 9 THEN '172.' || (p % 40) || '.1.1'
                    WHEN 10 THEN '192.168.' || (p % 300) || '.1' WHEN 11 THEN '127.0.0.' || (p % 256)
                    WHEN 12 THEN '256.1.1.1' WHEN 13 THEN '::FFFF:8.8.' || (p % 256) || '.1' WHEN 14 THEN '01.2.3.4'
                    WHEN 15 THEN '::' WHEN 16 THEN '1::2::3' WHEN 17 THEN '0.0.0.0' WHEN 18 THEN ''
                    WHEN 19 THEN '::ffff:172.' || (p % 40) || '.0.1' ELSE '53.0.0.' || (p % 200) END AS ip,
               (9000 + p % 7)::INT AS tcp, (9000 + p % 5)::INT AS udp,
               CASE WHEN node % 43 <> 5 THEN md5('k' || (node // 3)) END AS pubkey,
               CASE WHEN p % 17 = 0 THEN NULL WHEN p % 19 = 0 THEN '0x1234'
                    WHEN p % 23 = 0 THEN '0x0000000001000000' || ep
                    ELSE ({DIGESTS})[(node + p) % 4 + 1] || '01000000' || ep END AS eth2,
               CASE WHEN p % 10 = 0 THEN NULL WHEN p % 37 = 1 THEN '' WHEN p % 37 = 2 THEN '0x' WHEN p % 37 = 3 THEN 'zz'
                    WHEN p % 37 = 4 THEN '0x' || substr(md5(p_name), 1, 16) ELSE substr(md5(p_name), 1, 16) END AS attnets, p
        FROM (SELECT *, p_partkey AS p, p_partkey // 4 AS node,
                     CASE WHEN p_partkey % 2 = 0 THEN 'ffffffffffffffff' ELSE '2c01000000000000' END AS ep
              FROM part)""",
    "b_records": f"""
        SELECT * REPLACE (lower(replace(attnets, '0x', '')) AS attnets),
               CASE WHEN replace(attnets, '0x', '') = '' THEN 'empty' WHEN attnets = 'zz' THEN 'invalid hex' END AS attnets_error,
               CASE WHEN bad IS NULL AND eth2 IS NOT NULL THEN substr(eth2, 1, 10) END AS fork_digest,
               CASE WHEN bad IS NULL AND eth2 IS NOT NULL THEN '0x' || substr(eth2, 11, 8) END AS next_fork_version,
               CASE WHEN bad IS NULL AND eth2 IS NOT NULL THEN
                    CASE WHEN p % 2 = 0 THEN '18446744073709551615' ELSE '300' END END AS next_fork_epoch,
               {attnets_bits('attnets')} AS attnets_number
        FROM (SELECT *, CASE WHEN eth2 IS NULL THEN NULL WHEN length(eth2) <> 34 THEN 'invalid size'
                             WHEN substr(eth2, 3, 8) = '00000000' THEN 'fork digest is empty' END AS bad
              FROM b_raw_records)""",
    "b_node_last": """
        SELECT node_id, arg_min(struct_pack(peer_id := peer_id, pubkey := pubkey), ord) AS k,
               arg_max(struct_pack(timestamp := timestamp, seq := seq, ip := ip, tcp := tcp, udp := udp,
                       fork_digest := fork_digest, next_fork_version := next_fork_version,
                       attnets := attnets, attnets_number := attnets_number), ord) AS r,
               min(ord) AS first_ord FROM b_records GROUP BY node_id""",
    "b_node_rank": """
        SELECT *, row_number() OVER (PARTITION BY k.peer_id, k.pubkey, own ORDER BY first_ord, node_id) AS rn,
               first_value(node_id) OVER (PARTITION BY k.peer_id, k.pubkey, own ORDER BY first_ord, node_id) AS owner
        FROM (SELECT *, CASE WHEN k.peer_id IS NULL OR k.pubkey IS NULL THEN node_id END AS own FROM b_node_last)""",
    "b_nodes": """
        SELECT k.peer_id AS peer_id, k.pubkey AS pubkey, node_id, r.timestamp AS timestamp, r.seq AS seq,
               r.ip AS ip, r.tcp AS tcp, r.udp AS udp, r.fork_digest AS fork_digest,
               r.next_fork_version AS next_fork_version, r.attnets AS attnets,
               r.attnets_number AS attnets_number FROM b_node_rank WHERE rn = 1""",
    "b_recent_nodes": """
        SELECT * FROM b_nodes WHERE fork_digest IS NOT NULL
          AND timestamp > epoch(TIMESTAMP '2001-08-02 00:00:00')::BIGINT - 86400""",
    "b_probes": """
        SELECT l_suppkey AS peer, l_linenumber AS cpl, l_partkey AS neighbour, l_returnflag = 'R' AS failed
        FROM lineitem""",
    "b_edges": "SELECT DISTINCT peer, neighbour FROM b_probes WHERE NOT failed",
    # ------------------------------------------------------------ connection pairs
    "b_half_next": """
        SELECT *, lead(kind) OVER w AS next_kind, lead(ts) OVER w AS next_ts FROM b_halves
        WINDOW w AS (PARTITION BY peer_id ORDER BY ts, seq)""",
    "b_pairs": """
        SELECT peer_id, CASE direction WHEN 1 THEN 'inbound' WHEN 2 THEN 'outbound' ELSE 'unset' END AS direction,
               floor(epoch(ts))::BIGINT AS conn_time, latency_ns // 1000000 AS latency,
               floor(epoch(next_ts))::BIGINT AS disconn_time, identified, error, next_ts AS ts, seq
        FROM b_half_next WHERE kind = 'open' AND next_kind = 'close' AND next_ts > ts""",
}


def retry_views(prefix, classes, positive, base, growing, cap, after):
    """Views of lives, live attempts and retry state under one policy.

    Each life is found from the previous one by recursion; runs of equal class
    are found by gaps and islands.
    """
    arms = " ".join(
        f"WHEN error IN ({', '.join(q(e) for e in codes)}) THEN {q(name)}" for name, codes in classes
    )
    bases = " ".join(f"WHEN {q(n)} THEN {s}" for n, s in base.items())
    grows = ", ".join(q(n) for n in growing)
    return {
        f"{prefix}_classed": f"""
            SELECT peer_id, ts, seq, status, error, CASE {arms} ELSE 'NegativeWithHope' END AS cls FROM b_attempts""",
        f"{prefix}_marked": f"""
            SELECT *, max(CASE WHEN cls = {q(positive)} THEN ts END) OVER (
                PARTITION BY peer_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS success FROM {prefix}_classed""",
        f"{prefix}_stale": f"""
            SELECT peer_id, ts FROM {prefix}_marked WHERE cls <> {q(positive)}
              AND (success IS NULL OR epoch_us(ts) - epoch_us(success) >= {after}::BIGINT * 1000000)""",
        f"{prefix}_lives": f"""
            SELECT f.peer_id, 1 AS life, f.start_ts,
                   (SELECT min(s.ts) FROM {prefix}_stale s WHERE s.peer_id = f.peer_id
                      AND epoch_us(s.ts) - epoch_us(f.start_ts) >= {after}::BIGINT * 1000000) AS end_ts
            FROM (SELECT peer_id, min(ts) AS start_ts FROM b_discoveries GROUP BY 1) f
            UNION ALL
            SELECT n.peer_id, n.life, n.start_ts,
                   (SELECT min(s.ts) FROM {prefix}_stale s WHERE s.peer_id = n.peer_id
                      AND epoch_us(s.ts) - epoch_us(n.start_ts) >= {after}::BIGINT * 1000000) AS end_ts
            FROM (SELECT l.peer_id, l.life + 1 AS life,
                         (SELECT min(d.ts) FROM b_discoveries d WHERE d.peer_id = l.peer_id AND d.ts > l.end_ts) AS start_ts
                  FROM {prefix}_lives l WHERE l.end_ts IS NOT NULL) n
            WHERE n.start_ts IS NOT NULL""",
        f"{prefix}_live": f"""
            SELECT a.*, l.life, coalesce(a.ts = l.end_ts, false) AS deprecable
            FROM {prefix}_classed a JOIN {prefix}_lives l ON a.peer_id = l.peer_id
             AND a.ts > l.start_ts AND (l.end_ts IS NULL OR a.ts <= l.end_ts)""",
        f"{prefix}_islands": f"""
            SELECT *, sum(changed) OVER (PARTITION BY peer_id, life ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run
            FROM (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY peer_id, life ORDER BY ts, seq) = cls THEN 0 ELSE 1 END AS changed
                  FROM {prefix}_live)""",
        f"{prefix}_final": f"""
            SELECT peer_id, life, cls, error, ts, seq, row_number() OVER (PARTITION BY peer_id, life, run ORDER BY ts, seq) AS degree,
                   row_number() OVER (PARTITION BY peer_id, life ORDER BY ts DESC, seq DESC) AS back
            FROM {prefix}_islands""",
        f"{prefix}_turns": f"""
            SELECT peer_id, life::INT AS life, cls, degree, ts + to_seconds(CASE WHEN cls IN ({grows})
                     THEN least((CASE cls {bases} ELSE 0 END) * pow(2, least(degree - 1, 30)), {cap})::BIGINT
                     ELSE least(CASE cls {bases} ELSE 0 END, {cap}) END) AS due,
                   lead(ts) OVER (PARTITION BY peer_id, life ORDER BY ts, seq) AS after, ts = end_ts AS ends
            FROM {prefix}_final JOIN (SELECT peer_id, life, end_ts FROM {prefix}_lives) USING (peer_id, life)
            UNION ALL SELECT peer_id, life, 'Minus1', 0, start_ts, NULL, false FROM {prefix}_lives""",
        f"{prefix}_history": f"""
            SELECT l.peer_id, l.life::INT AS life, l.start_ts AS life_start, coalesce(f.cls, 'Minus1') AS delay_class,
                   coalesce(f.degree, 0)::BIGINT AS degree, f.ts AS last_attempt,
                   f.ts + to_seconds(CASE WHEN f.cls IN ({grows})
                        THEN least((CASE f.cls {bases} ELSE 0 END) * pow(2, least(f.degree - 1, 30)), {cap})::BIGINT
                        ELSE least(CASE f.cls {bases} ELSE 0 END, {cap}) END) AS next_attempt,
                   l.end_ts IS NOT NULL AS deprecable, coalesce(f.error, '--') AS last_error
            FROM {prefix}_lives l LEFT JOIN {prefix}_final f
              ON l.peer_id = f.peer_id AND l.life = f.life AND f.back = 1""",
        f"{prefix}_state": f"""
            SELECT * FROM {prefix}_history h
            WHERE life = (SELECT max(life) FROM {prefix}_history g WHERE g.peer_id = h.peer_id)""",
    }


DAY = 86400
VIEWS.update(
    retry_views("r", D.DELAY_CLASS_ERRORS, "Positive",
                {"Positive": 120, "NegativeWithHope": 120, "NegativeWithNoHope": 0, "Timeout": 1920},
                ["Timeout"], 2048 * 60, 30 * DAY)
)
VIEWS.update(
    retry_views("s", D.DELAY_CLASS_ERRORS, "Positive",
                {"Positive": 120, "NegativeWithHope": 120, "NegativeWithNoHope": 0, "Timeout": 1920},
                ["Timeout"], 2048 * 60, 2 * DAY)
)
VIEWS.update(
    retry_views("c",
                [("Positive", ["none"]),
                 ("NegativeWithNoHope", ["connection_refused", "no_route_to_host"]),
                 ("Timeout", ["io_timeout"])],
                "Positive",
                {"Positive": 60, "NegativeWithHope": 30, "NegativeWithNoHope": 600, "Timeout": 1920},
                ["Timeout", "NegativeWithHope"], 7200, 3 * DAY)
)
