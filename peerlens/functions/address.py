"""Multiaddress and IP expressions."""

from pyspark.sql import functions as F

# Address formats and the ranges that are not public.
IPV4 = r"((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NOT_PUBLIC_V4 = r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0$)"
GROUPS = r"^[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*$"
# Shape of an address that can be dialled: protocol/value pairs.
MULTIADDR = r"^(/[a-z0-9-]+/[^/]+)+$"


def _let(value, use):
    """`use(value)` with the value computed once, however often it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sides(ip):
    """The colon-separated groups before and after `::` of an address whose dotted end became two groups."""
    dotted = F.regexp_extract(ip, rf"(?<=:){IPV4}$", 0)

    def hexed(d):
        octet = lambda i: F.element_at(F.split(d, r"\."), i).cast("int")
        pair = lambda i: F.hex((octet(i) * 256 + octet(i + 1)).cast("long"))
        return F.when(d == "", ip).otherwise(
            F.concat(F.substr(ip, F.lit(1), F.length(ip) - F.length(d)), pair(1), F.lit(":"), pair(3))
        )

    return F.split(_let(dotted, hexed), "::")


def _groups(ip):
    """The eight 16-bit groups of an IPv6 text, or NULL if it is none."""
    def expand(sides):
        parts = F.transform(sides, lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":")))
        shaped = F.forall(sides, lambda s: (s == "") | s.rlike(GROUPS))
        n = F.aggregate(parts, F.lit(0), lambda a, p: a + F.size(p))
        whole = (F.size(sides) == 1) & (n == 8)
        short = (F.size(sides) == 2) & (n <= 7)
        zeros = F.array_repeat(F.lit("0"), 8 - n)
        all_groups = F.concat(parts[0], zeros, F.coalesce(F.get(parts, F.lit(1)), F.array().cast("array<string>")))
        return F.when(shaped & (whole | short), F.transform(all_groups, lambda g: F.conv(g, 16, 10).cast("int")))

    return _let(_sides(ip), expand)


def _public_groups(groups):
    """Of eight groups: not loopback, unspecified, or an embedded private IPv4 address."""
    def decide(g):
        zeros = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
        own = zeros(7) & g[7].isin(0, 1)
        high, low = F.floor(g[6] / 256), g[6] % 256
        private = (
            high.isin(10, 127) | ((high == 192) & (low == 168)) | ((high == 172) & low.between(16, 31))
            | ((g[6] == 0) & (g[7] == 0))
        )
        return ~own & ~(zeros(5) & (g[5] == 0xFFFF) & private)

    return _let(groups, decide)


def is_valid_ip(ip):
    six = F.when(F.contains(ip, F.lit(":")), _groups(ip).isNotNull()).otherwise(F.lit(False))
    return F.when(ip.isNotNull(), ip.rlike(f"^{IPV4}$") | six)


def is_public_ip(ip):
    """False for private, loopback and unspecified addresses, however spelled, and for no address."""
    four = ip.rlike(f"^{IPV4}$") & ~ip.rlike(NOT_PUBLIC_V4)
    return F.coalesce(F.when(F.contains(ip, F.lit(":")), _public_groups(_groups(ip))).otherwise(four), F.lit(False))


def _maddr_part(address, place):
    return F.try_element_at(F.split(address, "/"), F.lit(place))


def maddr_ip(address):
    return _let(_maddr_part(address, 3), lambda part: F.when(is_valid_ip(part), part))


def maddr_port(address):
    part = F.try_element_at(F.split(address, "/"), F.lit(5))
    return F.coalesce(part.try_cast("int"), F.lit(-1))


def compose_maddr(ip, port):
    return F.concat(F.lit("/ip4/"), ip, F.lit("/tcp/"), port.cast("string"))


def first_public_addr(addresses):
    """struct(ip, port) of the first public address, or ('', 0)."""
    public = F.filter(addresses, lambda a: is_public_ip(_maddr_part(a, 3)))
    # A public address is a valid one.
    found = _let(
        F.try_element_at(public, F.lit(1)),
        lambda a: F.when(
            a.isNotNull(), F.struct(_maddr_part(a, 3).alias("ip"), maddr_port(a).alias("port"))
        ),
    )
    return F.coalesce(found, F.struct(F.lit("").alias("ip"), F.lit(0).alias("port")))


def is_multiaddr(address):
    return address.rlike(MULTIADDR)
