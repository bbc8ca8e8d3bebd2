"""Fork digests and discovery-record fields."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from peerlens import domains as D

_DIGEST = dict(D.FORK_DIGESTS)
# Hex lengths of the record fields.
HEX_LENGTH = {"digest": 8, "eth2": 32, "attnets": 16}


def valid_fork_digest(text):
    """Digest for a known lower-case name, a known digest or any 4-byte hex; else NULL."""
    names = [F.when(text == name.lower(), F.lit(digest)) for name, digest in D.FORK_DIGESTS]
    literal = F.when(
        text.isin([d for _, d in D.FORK_DIGESTS]) | text.rlike("^[0-9a-fA-F]{8}$"), text
    )
    return F.coalesce(*names, literal)


def genesis_for_digest(digest):
    """Genesis epoch seconds; forks without an entry use the main network's."""
    hits = [
        F.when(digest.isin([_DIGEST[f] for f in forks]), F.lit(genesis))
        for genesis, forks in D.GENESIS_FORKS
    ]
    return F.coalesce(*hits, F.lit(D.MAINNET_GENESIS)).cast("long")


def genesis_defaulted(digest):
    listed = [_DIGEST[f] for _, forks in D.GENESIS_FORKS for f in forks]
    return ~F.coalesce(digest.isin(listed), F.lit(False))


def _bare(text):
    return F.regexp_replace(text, "^0x", "")


def hex_error(bare, kind):
    """Why a hex text without prefix is not acceptable, or NULL."""
    return (
        F.when(bare.isNull(), F.lit("missing"))
        .when(~bare.rlike("^[0-9a-fA-F]*$") | (F.length(bare) % 2 == 1), F.lit("invalid hex"))
        .when(F.length(bare) != HEX_LENGTH[kind], F.lit("invalid size"))
    )


def hex_normalise(text, kind):
    """struct(value, error): strip 0x, check alphabet, check length."""
    bare = _bare(text)
    error = hex_error(bare, kind)
    return F.struct(F.when(error.isNull(), F.lower(bare)).alias("value"), error.alias("error"))


def attnets_count(bitmask):
    """Set bits of a hex bitmask by nibble classes; -1 without a bitmask or with an empty one, NULL if it is no hex.

    Works for any length: the digits with n bits are counted by removing them.
    """
    h = F.lower(_bare(bitmask))
    classes = [(1, "1248"), (2, "3569ac"), (3, "7bde"), (4, "f")]
    bits = [(F.length(h) - F.length(F.translate(h, digits, ""))) * n for n, digits in classes]
    wrong = attnets_error(bitmask)
    count = F.when(h.isNull() | (wrong == "empty"), F.lit(-1)).when(wrong.isNull(), reduce(add, bits))
    return count.cast("int")


def attnets_error(bitmask):
    """Why a present bitmask cannot be counted ("empty" or "invalid hex"), or NULL."""
    h = _bare(bitmask)
    return F.when(h == "", F.lit("empty")).when(
        ~h.rlike("^[0-9a-fA-F]*$") | (F.length(h) % 2 == 1), F.lit("invalid hex")
    )


def _eth2_error(text, bare):
    empty = F.when(F.substring(bare, 1, 8) == "00000000", F.lit("fork digest is empty"))
    return F.when(text.isNotNull(), F.coalesce(hex_error(bare, "eth2"), empty))


def _eth2_parts(text, bare, error):
    """Named columns out of a checked record field.

    The epoch is a little-endian unsigned 64-bit number, kept as text.
    """
    flipped = F.concat(*[F.substring(bare, 31 - 2 * i, 2) for i in range(8)])
    good = text.isNotNull() & error.isNull()
    return [
        F.when(good, F.concat(F.lit("0x"), F.substring(bare, 1, 8))).alias("fork_digest"),
        F.when(good, F.concat(F.lit("0x"), F.substring(bare, 9, 8))).alias("next_fork_version"),
        F.when(good, F.conv(flipped, 16, 10)).alias("next_fork_epoch"),
        text.isNotNull().alias("exists"),
        error.alias("error"),
    ]


def eth2_data_fields(text):
    """struct(fork_digest, next_fork_version, next_fork_epoch, exists, error)."""
    bare = F.lower(_bare(text))
    return F.struct(*_eth2_parts(text, bare, _eth2_error(text, bare)))


def with_eth2_data(df, column="eth2"):
    """Add the same fields as columns, one step per projection to keep each small."""
    text = F.col(column)
    checked = df.withColumn("_bare", F.lower(_bare(text))).withColumn(
        "_error", _eth2_error(text, F.col("_bare"))
    )
    return checked.select("*", *_eth2_parts(text, F.col("_bare"), F.col("_error"))).drop(
        "_bare", "_error"
    )


def enr_fork_match(fork_digest, wanted):
    """Whether a record passes the fork filter; `all` passes everything."""
    if wanted == D.ALL_FORKS:
        return F.lit(True)
    return F.coalesce(fork_digest == wanted, F.lit(False))
