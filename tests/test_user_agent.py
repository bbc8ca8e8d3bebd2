import pytest

from peerlens import domains as D
from peerlens.functions import user_agent as ua

U = "unknown"
# User agents with their expected client, version, system and architecture.
ETHEREUM_AGENTS = [
    ("teku/teku/v21.8.2/linux-x86_64/corretto-java-16", "teku", "v21.8.2", "linux", "x86_64"),
    ("teku/teku/v21.7.0+9-g77b4b9e/linux-x86_64/-ubuntu-openjdk64bitservervm-java-11", "teku", "v21.7.0", "linux", "x86_64"),
    ("Prysm/v1.4.3/8bca66ac6408a03af52d65541f58384007ed50ef", "prysm", "v1.4.3", U, U),
    ("Prysm/v1.3.8-hotfix+6c0942/6c09424feb3141b96016bed817d7ade1cd75deb7", "prysm", "v1.3.8", U, U),
    ("Lighthouse/v1.5.1-b0ac346/x86_64-linux", "lighthouse", "v1.5.1", "linux", "x86_64"),
    ("Lighthouse/v3.1.2/aarch64-macos", "lighthouse", "v3.1.2", "mac", "arm"),
    ("Lighthouse/v2.5.1-df51a73/aarch64-linux", "lighthouse", "v2.5.1", "linux", "arm"),
    ("nimbus", "nimbus", U, U, U),
    ("rust-libp2p/0.36.1", "grandine", "0.36.1", U, U),
    ("js-libp2p/0.36.2", "lodestar", "0.36.2", U, U),
    ("lodestar/v1.2.0", "lodestar", "v1.2.0", U, U),
    ("nim-libp2p/0.0.1", "nimbus", "0.0.1", U, U),
    # A published expectation says `unknown` here; the rule says segment 2.
    ("erigon/lightclient", "erigon", "lightclient", U, U),
    ("erigon", "erigon", U, U, U),
]
OTHERS = [
    (D.IPFS, "go-ipfs/0.8.0/48f94e2", "go-ipfs", "0.8.0"),
    (D.IPFS, "hydra-booster/0.7.4", "hydra-booster", "0.7.4"),
    (D.IPFS, "storm", "storm", U),
    (D.IPFS, "kubo/0.15.0-dev/", "kubo", "0.15.0"),
    (D.IPFS, "ioi", "ioi", U),
    (D.IPFS, "punchr/honeypot/dev+", "punchr", U),
    (D.FILECOIN, "lotus-1.13.0+mainnet+git.7a55e8e8", "lotus", "1.13.0"),
    (D.FILECOIN, "lotus", "lotus", U),
    (D.FILECOIN, "go-ipfs/0.8.0", U, U),
    (D.POLYGON, "bor/v1.0.3-stable/linux", "bor", "v1.0.3"),
    (D.CELO, "Geth/v1.13.0/x", "celo-geth", "v1.13.0"),
    ("Elsewhere", "bor/v1", "", ""),
    (D.ETHEREUM, "", U, U),
    # The first table row wins when several words occur.
    (D.ETHEREUM, "teku-prysm/a/b", "prysm", "a"),
]


def parsed(spark, rows):
    df = spark.createDataFrame(rows, "n int, network string, user_agent string")
    both = ua.with_client(df).select("*", ua.parse_client("user_agent", "network").alias("s"))
    return {r.n: r for r in both.collect()}


def test_ethereum_agents(spark):
    got = parsed(spark, [(i, D.ETHEREUM, a[0]) for i, a in enumerate(ETHEREUM_AGENTS)])
    for i, (_, *expected) in enumerate(ETHEREUM_AGENTS):
        r = got[i]
        assert [r.client_name, r.client_version, r.client_os, r.client_arch] == expected
        assert list(r.s) == expected


def test_other_networks(spark):
    got = parsed(spark, [(i, n, a) for i, (n, a, _, _) in enumerate(OTHERS)])
    for i, (_, _, name, version) in enumerate(OTHERS):
        assert (got[i].client_name, got[i].client_version) == (name, version)
        assert (got[i].s.client_name, got[i].s.client_version) == (name, version)


def test_no_agent(spark):
    r = parsed(spark, [(0, D.ETHEREUM, None)])[0]
    assert r.s is None and r.client_name is None and r.client_os is None


@pytest.mark.parametrize("text,os", [("x/darwin", "windows"), ("linux/windows", "windows"), ("macos-linux", "mac")])
def test_ambiguous_os_takes_declared_order(spark, text, os):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(ua.ua_client_os("t")).first()[0] == os


def test_identity_and_latency(spark):
    rows = [("", "", []), ("a", "", []), ("", "p", []), ("", "", ["x"]), (None, None, None)]
    df = spark.createDataFrame(rows, "user_agent string, protocol_version string, protocols array<string>")
    assert [r[0] for r in df.select(ua.is_identified()).collect()] == [False, True, True, True, False]
    ns = spark.createDataFrame([(100_000,), (1_999_999,), (None,)], "ns bigint")
    assert [r[0] for r in ns.select(ua.latency_ms("ns")).collect()] == [0, 1, None]
