"""Warehouse tables and event logs derived from the test tables.

Each view is one deterministic projection of `customer`, `orders`, `nation`,
`region`, `events`, `part`, `lineitem`; `peerlens.plans.bridge_sql` states the
same views in SQL for the cross-check.  Nothing here drops or samples rows.
"""

import os

from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.functions.user_agent import with_client

# Moments at which the bridged data is looked at, and inputs.
AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
SELF_ID = "Customer#000000000"
DIGEST = "0xb5303f2a"
DIGESTS = ["0xb5303f2a", "0xafcaaba0", "0x4a26c58b", "0xbba4da96"]
PROTOCOLS = [
    "/ipfs/id/1.0.0",
    "/ipfs/ping/1.0.0",
    "/meshsub/1.1.0",
    "/eth2/beacon_chain/req/status/1/ssz_snappy",
]
AGENT_FORMS = 12


def composed_agent(network, i):
    """The i-th user agent of a network, put together by rule: a client word, a version, a build mark and a system.

    The word comes from the network's keywords (now and then from the next network's, or from none); every fifth is
    in capitals, every sixth stands alone.
    """
    words = [w.split("/")[0] for _, keywords in D.CLIENT_WORDS[network] for w in keywords]
    other = D.CLIENT_WORDS[D.NETWORKS[(D.NETWORKS.index(network) + 1) % len(D.NETWORKS)]]
    word = "other" if i % 9 == 8 else other[i % len(other)][0] if i % 7 == 6 else words[i % len(words)]
    version = f"{'v' * (i % 2)}{i % 3}.{i * 3 % 10}.{i * 7 % 11}" + ["", f"-pre.{i}", f"+{i}b", f"+{i}-b{i * 37:x}"][i % 4]
    systems = [o for _, names in D.OS_WORDS for o in names]
    machines = [m for _, names in D.ARCH_WORDS for m in names]
    system, machine = systems[i * 7 // 3 % len(systems)], machines[i % len(machines)]
    system = [f"/{system}-{machine}", "", f"/{machine}/{system}"][i % 3]
    shown = word.upper() if i % 5 == 4 else word
    if i % 6 == 5:
        return shown
    if network == D.FILECOIN:
        return f"{shown}-{version}{system}"
    return "/".join([shown] * (D.VERSION_SEGMENT.get(word, 2) - 1) + [version]) + system


AGENTS = {n: [composed_agent(n, i) for i in range(AGENT_FORMS)] for n in D.NETWORKS}


def table(spark, directory, name):
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))


def _list(values):
    return "array(" + ", ".join("'" + v + "'" for v in values) + ")"


def pick(values, index):
    """SQL: element of a fixed list by a 0-based index."""
    return f"element_at({_list(values)}, cast({index} AS int) + 1)"


def _agent(network_index, index):
    """SQL: user agent of a network, numbered within the network's list."""
    lists = ", ".join(_list(AGENTS[n]) for n in D.NETWORKS)
    agents = f"element_at(array({lists}), cast({network_index} AS int) + 1)"
    return f"element_at({agents}, cast(({index}) % size({agents}) AS int) + 1)"


def peer_info(spark, directory, activity=True):
    """`peer_info`, one row per customer.

    `activity=False` leaves out the order-derived columns, and with them the
    join, for the many queries that do not look at them.
    """
    rows = table(spark, directory, "customer")
    if activity:
        last = (
            table(spark, directory, "orders")
            .groupBy("o_custkey")
            .agg(F.expr("unix_timestamp(cast(max(o_orderdate) AS timestamp))").alias("last_order"))
        )
        rows = rows.join(last, rows.c_custkey == last.o_custkey, "left")
    else:
        rows = rows.withColumn("last_order", F.lit(None).cast("long"))
    # A few peers are relabelled after their client was read: contamination.
    rows = rows.selectExpr(
        "c_custkey AS k",
        "c_name AS peer_id",
        "c_acctbal",
        f"{pick(D.NETWORKS, 'c_custkey % 5')} AS read_as",
        f"{pick(D.NETWORKS, '(c_custkey + cast(c_custkey % 29 = 7 AS int)) % 5')} AS network",
        "concat('52.', c_nationkey, '.0.', c_custkey % 37) AS ip",
        "cast(9000 + c_custkey % 7 AS int) AS port",
        f"CASE WHEN c_custkey % 13 <> 0 THEN {_agent('c_custkey % 5', 'c_custkey % 12')} END AS user_agent",
        "CASE WHEN c_custkey % 11 <> 0 THEN last_order END AS last_activity",
    )
    return with_client(rows, "user_agent", "read_as").selectExpr(
        "cast(k AS int) AS id",
        "peer_id",
        "network",
        "array('/ip4/10.0.0.1/tcp/1', concat('/ip4/', ip, '/tcp/', port)) AS multi_addrs",
        "ip",
        "port",
        "user_agent",
        "client_name",
        "client_version",
        "client_os",
        "client_arch",
        "CASE WHEN user_agent IS NOT NULL THEN 'eth2/1.0.0' END AS protocol_version",
        f"slice({_list(PROTOCOLS)}, 1, cast(1 + k % 4 AS int)) AS sup_protocols",
        "CASE WHEN k % 23 <> 0 THEN cast(floor(abs(c_acctbal)) % 1200 AS int) END AS latency",
        "c_acctbal < 0 AS deprecated",
        "CASE WHEN k % 9 <> 0 THEN true END AS attempted",
        "last_activity",
        "last_activity + 60 AS last_conn_attempt",
        f"{pick(D.ERROR_CODES, 'k % 29')} AS last_error",
    )


def geo_answers(spark, directory):
    """One geolocation answer per address in use; some lookups fail.

    Host 32 is answered, but without a place.
    """
    nation = table(spark, directory, "nation")
    region = table(spark, directory, "region")
    addresses = (
        table(spark, directory, "customer")
        .selectExpr("c_nationkey AS nk", "c_custkey % 37 AS host")
        .distinct()
    )
    located = addresses.join(nation, addresses.nk == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    return located.selectExpr(
        "cast(nk * 37 + host AS int) AS id",
        "concat('52.', nk, '.0.', host) AS ip",
        "CASE WHEN host < 33 THEN 'success' ELSE 'fail' END AS status",
        f"timestamp'{AS_OF}' + make_dt_interval(cast(nk - 12 AS int)) AS expiration_time",
        "r_name AS continent",
        "concat('R', r_regionkey) AS continent_code",
        "CASE WHEN host = 32 THEN '' ELSE n_name END AS country",
        "concat('C', nk) AS country_code",
        "cast(nk % 4 AS string) AS region",
        "concat(n_name, ' area') AS region_name",
        "CASE WHEN host = 32 OR nk % 6 = 0 THEN '' ELSE n_name END AS city",
        "'' AS zip",
        "cast(nk - 12.25 AS float) AS lat",
        "cast(nk * 2 + 0.5 AS float) AS lon",
        "concat('ISP', nk % 8) AS isp",
        "CASE WHEN nk % 8 = 0 THEN '' ELSE concat('AS', nk % 8) END AS org",
        "concat('AS6450', nk % 8, ' raw') AS as_raw",
        "CASE WHEN nk % 8 = 0 THEN '' ELSE concat('AS', nk % 8) END AS asname",
        "nk % 7 = 0 AS mobile",
        "nk % 5 = 0 AS proxy",
        "nk % 3 = 0 AS hosting",
    )


def ips(spark, directory):
    return geo_answers(spark, directory).filter(F.col("status") == "success").drop("status")


def geo_answer_json(spark, directory):
    """The same answers as the raw JSON documents a lookup returns."""
    a = geo_answers(spark, directory)
    names = {
        "query": "ip", "continentCode": "continent_code", "countryCode": "country_code",
        "regionName": "region_name", "as": "as_raw",
    }
    keys = [
        "query", "status", "continent", "continentCode", "country", "countryCode", "region",
        "regionName", "city", "zip", "lat", "lon", "isp", "org", "as", "asname", "mobile",
        "proxy", "hosting",
    ]
    return a.select(
        F.to_json(F.struct(*[F.col(names.get(key, key)).alias(key) for key in keys])).alias("value")
    )


# ---------------------------------------------------------------- event logs


def events(source):
    """Common columns of every event log; works on a batch or a streaming read."""
    return source.selectExpr(
        "concat('Customer#', lpad(cast(user_id AS string), 9, '0')) AS peer_id",
        "cast(ts AS timestamp) AS ts",
        "event_id AS seq",
        "user_id AS u",
        "event_id AS e",
        "event_type",
        "value",
        "props",
    )


def read_events(spark, directory):
    return events(table(spark, directory, "events"))


_ADDRESS = "concat('/ip4/52.', u % 25, '.0.', e % 37, '/tcp/', 9000 + e % 7)"
_LATENCY = "cast(round(value * 1000000) AS bigint)"
_SLOT = f"floor((unix_timestamp(ts) - {D.MAINNET_GENESIS}) / {D.SECONDS_PER_SLOT})"


def conn_halves(ev):
    """Open and close notifications."""
    return ev.filter("event_type IN ('view', 'click')").selectExpr(
        "peer_id",
        "CASE event_type WHEN 'view' THEN 'open' ELSE 'close' END AS kind",
        "ts",
        "seq",
        "CASE event_type WHEN 'view' THEN cast(e % 3 AS int) END AS direction",
        f"CASE event_type WHEN 'view' THEN {_LATENCY} END AS latency_ns",
        "CASE event_type WHEN 'view' THEN e % 6 <> 0 END AS identified",
        "CASE event_type WHEN 'view' THEN IF(e % 6 <> 0, 'None', 'error requesting metadata') END AS error",
    )


def raw_dials(ev):
    """Outcome of every dial: no message on success."""
    fragments = [f for _, f in D.ERROR_FRAGMENTS] + ["something else"]
    message = f"concat('dial failed: ', {pick(fragments, f'e % {len(fragments)}')})"
    return ev.filter("event_type IN ('purchase', 'error')").selectExpr(
        "peer_id", "ts", "seq", f"CASE event_type WHEN 'error' THEN {message} END AS message"
    )


def discoveries(ev):
    """Peers announced by discovery, known ones included."""
    return ev.filter("event_type = 'signup'").selectExpr(
        "peer_id",
        "ts",
        "seq",
        f"{pick(D.NETWORKS, '(u + cast(e % 11 = 0 AS int)) % 5')} AS network",
        f"""IF(e % 19 = 0, array('/ip4/10.0.0.1/tcp/1'),
               array('/ip4/10.0.0.1/tcp/1', {_ADDRESS})) AS multi_addrs""",
        "CASE WHEN e % 31 <> 0 THEN concat('52.0.0.', e % 37) END AS node_ip",
        "cast(IF(e % 17 = 0, 0, 9000 + e % 7) AS int) AS node_tcp",
    )


def raw_connections(ev):
    """Opened connections with everything the peer answered."""
    return ev.filter("event_type = 'view'").withColumn("h", F.expr("md5(cast(e AS string))")).selectExpr(
        "peer_id",
        "ts",
        "seq",
        f"{pick(D.NETWORKS, 'u % 5')} AS network",
        f"array({_ADDRESS}) AS multi_addrs",
        "CASE WHEN e % 6 = 0 THEN 'context deadline exceeded' END AS identify_error",
        f"CASE WHEN e % 13 = 0 THEN '' ELSE {_agent('u % 5', 'e % 12')} END AS user_agent",
        "CASE WHEN e % 13 = 0 THEN '' ELSE 'eth2/1.0.0' END AS protocol_version",
        f"""IF(e % 13 = 0, cast(array() AS array<string>),
               slice({_list(PROTOCOLS)}, 1, cast(1 + e % 4 AS int))) AS protocols""",
        f"{_LATENCY} AS latency_ns",
        "CASE WHEN e % 4 = 0 THEN 'stream reset' END AS status_error",
        f"CASE WHEN e % 4 <> 0 THEN {pick(DIGESTS, 'u % 4')} END AS fork_digest",
        "CASE WHEN e % 4 <> 0 THEN h END AS finalized_root",
        f"CASE WHEN e % 4 <> 0 THEN floor({_SLOT} / 32) - 2 END AS finalized_epoch",
        "CASE WHEN e % 4 <> 0 THEN md5(h) END AS head_root",
        f"CASE WHEN e % 4 <> 0 THEN {_SLOT} - e % 3 END AS head_slot",
        "CASE WHEN e % 3 = 0 THEN 'stream reset' END AS metadata_error",
        "CASE WHEN e % 3 <> 0 THEN e % 100 END AS seq_number",
        "CASE WHEN e % 3 <> 0 THEN substring(h, 1, 16) END AS attnets",
        "CASE WHEN e % 3 <> 0 THEN substring(h, 17, 2) END AS syncnets",
    )


def messages(ev):
    """Gossip messages with decoded slot and proposer."""
    return ev.filter("event_type IN ('purchase', 'signup')").selectExpr(
        "peer_id AS sender",
        f"""concat('/eth2/{DIGEST[2:]}/',
               CASE e % 3 WHEN 0 THEN concat('{D.ATTESTATION_PREFIX}', IF(e % 7 = 0, 'x', cast(1 + e div 3 % 64 AS string)))
                          WHEN 1 THEN '{D.BLOCK_TOPIC}' ELSE 'voluntary_exit' END,
               '/{D.TOPIC_ENCODING}') AS topic""",
        "props AS payload",
        f"cast(IF(e % 50 = 0, 0, {_SLOT} - e % 2) AS bigint) AS slot",
        "e % 1000 AS proposer",
        "ts AS arrival_time",
        "seq",
    )


def raw_records(spark, directory):
    """Node records as announced: several per node, fields still in hex."""
    rows = table(spark, directory, "part").selectExpr(
        "p_partkey AS p",
        "p_partkey div 4 AS node",
        "p_size",
        "p_name",
        "IF(p_partkey % 2 = 0, 'ffffffffffffffff', '2c01000000000000') AS epoch",
    )
    return rows.selectExpr(
        f"unix_timestamp(timestamp'{AS_OF}') - (p % 48) * 3600 AS timestamp",
        "p AS ord",
        "IF(node % 41 <> 3, concat('P', node div 2), NULL) AS peer_id",
        "md5(cast(node AS string)) AS node_id",
        "cast(p_size AS bigint) AS seq",
        # Addresses of all classes and spellings, partly malformed.
        """CASE p % 31 WHEN 0 THEN '0::1' WHEN 1 THEN '::0' WHEN 2 THEN '::0001' WHEN 3 THEN '::ffff:a00:1'
                WHEN 4 THEN '0:0:0:0:0:ffff:10.0.0.1' WHEN 5 THEN concat('2001:db8::', p % 10000)
                WHEN 6 THEN concat('fe80::', p % 10000) WHEN 7 THEN '1:2:3:4:5::1:2:3:4:1.2.3.4'
                WHEN 8 THEN concat('10.', p % 256, '.0.1') WHEN 9 THEN concat('172.', p % 40, '.1.1')
                WHEN 10 THEN concat('192.168.', p % 300, '.1') WHEN 11 THEN concat('127.0.0.', p % 256)
                WHEN 12 THEN '256.1.1.1' WHEN 13 THEN concat('::FFFF:8.8.', p % 256, '.1') WHEN 14 THEN '01.2.3.4'
                WHEN 15 THEN '::' WHEN 16 THEN '1::2::3' WHEN 17 THEN '0.0.0.0' WHEN 18 THEN ''
                WHEN 19 THEN concat('::ffff:172.', p % 40, '.0.1') ELSE concat('53.0.0.', p % 200) END AS ip""",
        "cast(9000 + p % 7 AS int) AS tcp",
        "cast(9000 + p % 5 AS int) AS udp",
        "IF(node % 43 <> 5, md5(concat('k', node div 3)), NULL) AS pubkey",
        f"""CASE WHEN p % 17 = 0 THEN NULL
                WHEN p % 19 = 0 THEN '0x1234'
                WHEN p % 23 = 0 THEN concat('0x0000000001000000', epoch)
                ELSE concat({pick(DIGESTS, '(node + p) % 4')}, '01000000', epoch) END AS eth2""",
        # Absent, empty and undecodable bitmasks, with and without prefix.
        """CASE WHEN p % 10 = 0 THEN NULL WHEN p % 37 = 1 THEN '' WHEN p % 37 = 2 THEN '0x' WHEN p % 37 = 3 THEN 'zz'
                WHEN p % 37 = 4 THEN concat('0x', substring(md5(p_name), 1, 16))
                ELSE substring(md5(p_name), 1, 16) END AS attnets""",
    )


def probes(spark, directory):
    """Routing-table probes: one neighbour per row, or a failed probe."""
    return table(spark, directory, "lineitem").selectExpr(
        "l_suppkey AS peer",
        "l_linenumber AS cpl",
        "l_partkey AS neighbour",
        "l_returnflag = 'R' AS failed",
    )
