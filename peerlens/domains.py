"""Reference domains of the telemetry model.

Everything here is a fixed value that results depend on: word lists, code
lists, constants and formats.  Lists that are searched keep declaration order,
because the first match wins.
"""

# --------------------------------------------------------------------------
# Networks and client software
# --------------------------------------------------------------------------
ETHEREUM = "Ethereum CL"
IPFS = "IPFS"
FILECOIN = "Filecoin"
POLYGON = "Polygon"
CELO = "Celo"
NETWORKS = [ETHEREUM, IPFS, FILECOIN, POLYGON, CELO]

UNKNOWN = "unknown"

CLIENT_WORDS = {
    ETHEREUM: [
        ("prysm", ["prysm"]),
        ("lighthouse", ["lighthouse"]),
        ("teku", ["teku"]),
        ("nimbus", ["nimbus", "nim-libp2p"]),
        ("lodestar", ["lodestar", "js-libp2p"]),
        ("grandine", ["grandine", "rust-libp2p"]),
        ("cortze", ["cortex"]),
        ("trinity", ["trinity"]),
        ("erigon", ["erigon", "erigon/lightclient"]),
    ],
    IPFS: [
        ("kubo", ["kubo"]),
        ("go-ipfs", ["go-ipfs"]),
        ("hydra-booster", ["hydra-booster"]),
        ("storm", ["storm"]),
        ("ioi", ["ioi"]),
        ("punchr", ["punchr"]),
    ],
    FILECOIN: [("lotus", ["lotus"])],
    POLYGON: [("bor", ["bor"])],
    CELO: [("celo-geth", ["celo", "geth"])],
}

OS_WORDS = [
    ("mac", ["macos", "freebsd"]),
    ("windows", ["win", "windows"]),
    ("linux", ["linux", "ubuntu"]),
]

ARCH_WORDS = [
    ("arm", ["aarch64", "aarch", "aarch_64"]),
    ("x86_64", ["x86_64"]),
]

# Segment of the user agent (1-based, split by "/") that carries the version;
# clients that are not listed carry it in segment 2.
VERSION_SEGMENT = {"teku": 3}
# Recognised clients whose version is never reported.
UNVERSIONED_CLIENTS = ["punchr"]

# --------------------------------------------------------------------------
# Dial errors
# --------------------------------------------------------------------------
NO_ERROR = "none"
NEVER_TRIED = "--"

ERROR_CODES = [
    "none",
    "error requesting metadata",
    "resource_limit",
    "routing_not_found",
    "no_recent_network_activity",
    "canceled_stream_err_code_0",
    "msg_sender_invalidated",
    "hydra_booster_peer",
    "io_timeout",
    "dial to self attempted",
    "connection_refused",
    "connection_reset_by_peer",
    "backoff",
    "protocol_not_supported",
    "peer_id_mismatch",
    "no_route_to_host",
    "network_unreachable",
    "no_good_addresses",
    "no_addresses",
    "maddr_reset",
    "context_deadline_exceeded",
    "no_public_ip",
    "security_protocol_negotiation",
    "max_dial_attempts_exceeded",
    "unknown",
    "stream_reset",
    "host_is_down",
    "too_many_open_files",
    "negotiate_security_protocol_no_trailing_new_line",
]

ERROR_FRAGMENTS = [
    ("resource_limit", "resource limit exceeded"),
    ("routing_not_found", "routing: not found"),
    ("no_recent_network_activity", "no recent network activity"),
    ("canceled_stream_err_code_0", "canceled with error code 0"),
    ("msg_sender_invalidated", "message sender has been invalidated"),
    ("io_timeout", "i/o timeout"),
    ("dial to self attempted", "dial to self attempted"),
    ("connection_refused", "connection refused"),
    ("connection_reset_by_peer", "connection reset by peer"),
    ("backoff", "backoff"),
    ("protocol_not_supported", "protocol not supported"),
    ("peer_id_mismatch", "peer id mismatch"),
    ("no_route_to_host", "no route to host"),
    ("network_unreachable", "network is unreachable"),
    ("no_good_addresses", "no good addresses"),
    ("no_addresses", "no addresses"),
    ("context_deadline_exceeded", "context deadline exceeded"),
    ("no_public_ip", "no public IP address"),
    ("security_protocol_negotiation", "failed to negotiate security protocol: EOF"),
    ("max_dial_attempts_exceeded", "max dial attempts exceeded"),
    ("host_is_down", "host is down"),
    ("stream_reset", "stream reset"),
    ("too_many_open_files", "too many open files"),
    (
        "negotiate_security_protocol_no_trailing_new_line",
        "failed to negotiate security protocol: message did not have trailing newline",
    ),
]

# --------------------------------------------------------------------------
# Retry delays
# --------------------------------------------------------------------------
POSITIVE = "Positive"
HOPE = "NegativeWithHope"
NO_HOPE = "NegativeWithNoHope"
TIMEOUT = "Timeout"
FRESH = "Minus1"  # discovered, never dialled

DELAY_CLASS_ERRORS = [
    (POSITIVE, ["none"]),
    (
        HOPE,
        [
            "connection_reset_by_peer",
            "connection_refused",
            "context_deadline_exceeded",
            "backoff",
            "error requesting metadata",
            "unknown",
        ],
    ),
    (
        NO_HOPE,
        [
            "no_route_to_host",
            "network_unreachable",
            "peer_id_mismatch",
            "dial to self attempted",
            "no_good_addresses",
        ],
    ),
    (TIMEOUT, ["io_timeout"]),
]

BASE_DELAY_SECONDS = {POSITIVE: 120, HOPE: 120, NO_HOPE: 0, TIMEOUT: 1920}
MAX_DELAY_SECONDS = 2048 * 60
DEPRECATION_SECONDS = 30 * 86400

# --------------------------------------------------------------------------
# Forks, topics and slots
# --------------------------------------------------------------------------
ALL_FORKS = "all"
FORK_DIGESTS = [
    ("All", "all"),
    ("Mainnet", "0xb5303f2a"),
    ("Altair", "0xafcaaba0"),
    ("Bellatrix", "0x4a26c58b"),
    ("Capella", "0xbba4da96"),
    ("Deneb", "0x6a95a1a9"),
    ("Electra", "0xad532ceb"),
    ("GnosisPhase0", "0xf925ddc5"),
    ("Gnosisbellatrix", "0x56fdb5e0"),
    ("PraterPhase0", "0x79df0428"),
    ("PraterBellatrix", "0xc2ce3aa8"),
    ("PraterCapella", "0x628941ef"),
    ("SepoliaCapella", "0x47eb72b3"),
    ("HoleskyCapella", "0x17e2dad3"),
    ("DenebCancun", "0xee7b3a32"),
]

MAINNET_GENESIS = 1606824023
GOERLI_GENESIS = 1616508000
GNOSIS_GENESIS = 1638968400
SECONDS_PER_SLOT = 12

GENESIS_FORKS = [
    (MAINNET_GENESIS, ["Mainnet", "Altair", "Bellatrix"]),
    (GOERLI_GENESIS, ["PraterPhase0", "PraterBellatrix"]),
    (GNOSIS_GENESIS, ["GnosisPhase0", "Gnosisbellatrix"]),
]

BLOCK_TOPIC = "beacon_block"
TOPIC_BASES = [
    "beacon_block",
    "beacon_aggregate_and_proof",
    "voluntary_exit",
    "proposer_slashing",
    "attester_slashing",
]
ATTESTATION_PREFIX = "beacon_attestation_"
TOPIC_ENCODING = "ssz_snappy"
SUBNET_LIMIT = 64

# Published event names.
EVENT_ATTESTATION = "ethereum_attestation"
EVENT_TIMED_ATTESTATION = "timed_ethereum_attestation"

# --------------------------------------------------------------------------
# Windows, time-to-live and batch sizes
# --------------------------------------------------------------------------
ACTIVE_DAYS = 180
FORK_WINDOW_DAYS = 1
IP_TTL_DAYS = 30
METRIC_TICK = "15 seconds"
SNAPSHOT_TICK = "12 hours"

RTT_BUCKETS = [
    (0, 100, " 0-100ms"),
    (101, 200, "101-200ms"),
    (201, 300, "201-300ms"),
    (301, 400, "301-400ms"),
    (401, 500, "401-500ms"),
    (501, 600, "501-600ms"),
    (601, 700, "601-700ms"),
    (701, 800, "701-800ms"),
    (801, 900, "801-900ms"),
    (901, 1000, "901-1000ms"),
]
RTT_REST = "+1s"

DIRECTIONS = {1: "inbound", 2: "outbound"}
DIRECTION_UNSET = "unset"
