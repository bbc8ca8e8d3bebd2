import base64
import hashlib
import ipaddress

import pytest
from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.functions import address, errors, forks, gossip

IPS = [
    "1.1.1.1", "10.0.0.1", "11.0.0.1", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.1",
    "192.168.0.1", "192.167.1.1", "127.0.0.1", "127.9.9.9", "0.0.0.0", "0.0.0.1", "169.254.1.1",
    "100.64.0.1", "256.1.1.1", "1.1.1", "01.1.1.1", "", "abc", "::", "::1", "2001:db8::1", "fe80::1",
    "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::1.2.3.4",
    "1:2:3:4:5:6:1.2.3.4", "12345::", ":::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "0:0:0:0:0:0:0:1",
    "0::1", "::0", "::0001", "::ffff:a00:1", "0:0:0:0:0:ffff:10.0.0.1", "::ffff:7f00:1", "::ffff:0:0", "0000::0000", "::FFFF:c0a8:101",
    "1:2:3:4:5::1:2:3:4:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.400", "1::", ":1", "1:", "::ffff:172.20.1.1", "::ffff:172.32.1.1",
    "g::1", "1:2:3:4::5:6:7:8", "1:2:3::5:6:7:8",
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)


def evaluate(spark, values, build, kind="string"):
    rows = column(spark, values, kind).select("i", build(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def parses(text):
    try:
        ipaddress.ip_address(text)
        return True
    except ValueError:
        return False


def expected_public(text):
    if not parses(text):
        return False
    ip = ipaddress.ip_address(text)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    private = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]
    inside = ip.version == 4 and any(ip in ipaddress.ip_network(n) for n in private)
    return not (inside or ip.is_loopback or ip.is_unspecified)


def test_valid_ip(spark):
    assert evaluate(spark, IPS, address.is_valid_ip) == [parses(t) for t in IPS]


def test_public_ip(spark):
    assert evaluate(spark, IPS, address.is_public_ip) == [expected_public(t) for t in IPS]
    assert evaluate(spark, [None], address.is_public_ip) == [False]


def test_multiaddress_parts(spark):
    values = ["/ip4/1.2.3.4/tcp/9000/p2p/x", "/ip4/1.2.3.4", "/dns4/host/tcp/x", ""]
    assert evaluate(spark, values, address.maddr_ip) == ["1.2.3.4", "1.2.3.4", None, None]
    assert evaluate(spark, values, address.maddr_port) == [9000, -1, -1, -1]


def test_first_public_address(spark):
    rows = [
        ["/ip4/10.0.0.1/tcp/1", "/ip4/8.8.8.8/tcp/2", "/ip4/9.9.9.9/tcp/3"],
        ["/ip4/10.0.0.1/tcp/1"],
        ["/dns4/a/tcp/1", "/ip4/1.1.1.1/tcp/7"],
        [],
    ]
    got = evaluate(spark, rows, address.first_public_addr, "array<string>")
    assert [tuple(g) for g in got] == [("8.8.8.8", 2), ("", 0), ("1.1.1.1", 7), ("", 0)]


def test_error_codes(spark):
    messages = [f"dial: {f} (peer)" for _, f in D.ERROR_FRAGMENTS]
    assert evaluate(spark, messages, errors.classify_dial_error) == [c for c, _ in D.ERROR_FRAGMENTS]
    odd = ["I/O TIMEOUT", None, "backoff after connection refused"]
    # Case matters, no message is success, and the first listed fragment wins.
    assert evaluate(spark, odd, errors.classify_dial_error) == ["unknown", "none", "connection_refused"]


def test_delay_classes(spark):
    codes = D.ERROR_CODES + ["None", "--", None]
    got = dict(zip(codes, evaluate(spark, codes, errors.delay_class)))
    assert got["none"] == "Positive" and got["None"] == "NegativeWithHope"
    assert got["io_timeout"] == "Timeout" and got["no_route_to_host"] == "NegativeWithNoHope"
    assert got["host_is_down"] == "NegativeWithHope" and got[None] == "NegativeWithHope"
    assert evaluate(spark, [0, 1, 2, 3], errors.direction_name, "int") == ["unset", "inbound", "outbound", "unset"]


def test_topics(spark):
    digests = ["0x56fdb5e0", "b5303f2a"]
    got = evaluate(spark, digests, lambda d: gossip.compose_topic(d, F.lit("beacon_block")))
    # A digest's own trailing zero stays.
    assert got == ["/eth2/56fdb5e0/beacon_block/ssz_snappy", "/eth2/b5303f2a/beacon_block/ssz_snappy"]
    subnets = evaluate(spark, [0, 1, 64, 65], lambda n: gossip.compose_attnets_topic(F.lit("0xaa"), n), "int")
    assert subnets == ["", "/eth2/aa/beacon_attestation_1/ssz_snappy", "/eth2/aa/beacon_attestation_64/ssz_snappy", ""]
    topics = [subnets[1], got[0], "x"]
    assert evaluate(spark, topics, gossip.topic_pretty) == ["beacon_attestation_1", "beacon_block", None]
    assert evaluate(spark, topics, gossip.topic_subnet) == [1, None, None]


def test_message_id(spark):
    texts = ["", "a", "hello", "??>"]
    wanted = [base64.urlsafe_b64encode(hashlib.sha256(t.encode()).digest()).decode() for t in texts]
    assert evaluate(spark, texts, gossip.message_id) == wanted


def test_time_in_slot_can_be_negative(spark):
    df = spark.sql("SELECT timestamp_micros(1606824023000000 + 24500000) t, 2L s")
    assert df.select(gossip.time_in_slot(F.col("t"), F.col("s"), F.lit(D.MAINNET_GENESIS))).first()[0] == 0.5
    assert df.select(gossip.time_in_slot(F.col("t"), F.col("s") + 1, F.lit(D.MAINNET_GENESIS))).first()[0] == -11.5


def test_fork_digests(spark):
    texts = ["mainnet", "Mainnet", "0xb5303f2a", "all", "deadbeef", "0xdeadbeef", "xyz", "gnosisphase0"]
    wanted = ["0xb5303f2a", None, "0xb5303f2a", "all", "deadbeef", None, None, "0xf925ddc5"]
    assert evaluate(spark, texts, forks.valid_fork_digest) == wanted
    digests = ["0xb5303f2a", "0x79df0428", "0x56fdb5e0", "0x628941ef", "zz"]
    assert evaluate(spark, digests, forks.genesis_for_digest) == [1606824023, 1616508000, 1638968400, 1606824023, 1606824023]
    assert evaluate(spark, digests, forks.genesis_defaulted) == [False, False, False, True, True]


@pytest.mark.parametrize("text", ["ffffffffffffffff", "0x0100000000000080", "0f", "123456789abcdef0" * 3])
def test_attnets_bits(spark, text):
    bits = bin(int(text.removeprefix("0x") or "0", 16)).count("1")
    assert evaluate(spark, [text], forks.attnets_count) == [bits]


def test_record_fields(spark):
    assert evaluate(spark, [None], forks.attnets_count) == [-1]
    texts = ["0xB5303F2A" + "01000000" + "2c01000000000000", "b5303f2a" + "01000000" + "f" * 16,
             "0x1234", "0x00000000" + "01000000" + "f" * 16, "zz" * 16, None]
    got = [tuple(r) for r in evaluate(spark, texts, forks.eth2_data_fields)]
    assert got == [
        ("0xb5303f2a", "0x01000000", "300", True, None),
        ("0xb5303f2a", "0x01000000", str(2**64 - 1), True, None),
        (None, None, None, True, "invalid size"),
        (None, None, None, True, "fork digest is empty"),
        (None, None, None, True, "invalid hex"),
        (None, None, None, False, None),
    ]
    got = [tuple(r) for r in evaluate(spark, ["0xABCDEF01", "abc", None], lambda t: forks.hex_normalise(t, "digest"))]
    assert got == [("abcdef01", None), (None, "invalid hex"), (None, "missing")]
    df = column(spark, ["0xaa", None])
    assert df.filter(forks.enr_fork_match(F.col("v"), "0xaa")).count() == 1
    assert df.filter(forks.enr_fork_match(F.col("v"), "all")).count() == 2


def test_undecodable_bitmasks(spark):
    texts = ["", "0x", "zz", "0xabc", "0xff", None]
    assert evaluate(spark, texts, forks.attnets_count) == [-1, -1, None, None, 8, -1]
    assert evaluate(spark, texts, forks.attnets_error) == ["empty", "empty", "invalid hex", "invalid hex", None, None]


@pytest.mark.parametrize("tick, rate", [("15 seconds", 8.0), ("1 minute", 2.0), ("2 hours", 2 / 120)])
def test_rate_follows_the_window(spark, tick, rate):
    from peerlens.operators import distributions

    rows = spark.sql("SELECT 't' AS topic, timestamp'2024-01-01 00:00:01' AS arrival_time FROM range(2)")
    assert [r.per_minute for r in distributions.messages_per_topic(rows, tick).collect()] == [pytest.approx(rate)]


def test_every_missing_address_is_located(spark):
    from peerlens.operators import lookups

    peers = spark.range(9000).selectExpr("concat('52.', id div 200, '.0.', id % 200) AS ip")
    ips = peers.limit(0).selectExpr("ip", "timestamp'2024-01-01 00:00:00' AS expiration_time")
    assert lookups.ips_to_locate(peers, ips, "2024-01-01 00:00:00").count() == 9000
    assert lookups.ips_to_locate(peers, ips, "2024-01-01 00:00:00", batch=5).count() == 5


def test_a_client_of_two_networks_is_at_home_in_both(spark, monkeypatch):
    from peerlens.operators import audit

    words = {"A": [("both", ["both"]), ("one", ["one"])], "B": [("both", ["both"])]}
    monkeypatch.setattr(D, "CLIENT_WORDS", words)
    rows = spark.createDataFrame([("A", "both"), ("B", "both"), ("B", "one"), ("C", "both"), ("A", "none"), ("A", None)], "network string, client_name string")
    assert sorted(map(tuple, audit.contamination(rows).collect())) == [("B", "one", 1), ("C", "both", 1)]
