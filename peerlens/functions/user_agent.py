"""Client identity out of user-agent strings.

Arguments are SQL expressions (usually column names) and results are Columns:
the long keyword conditions are then parsed once inside Spark instead of being
put together call by call.
"""

from pyspark.sql import functions as F

from peerlens import domains as D


def _quote(text):
    return "'" + text.replace("'", "\\'") + "'"


def keyword_case(text, table):
    """SQL: name of the first table row with a word inside `text`, any case."""
    arms = [
        "WHEN " + " OR ".join(f"contains(lower({text}), {_quote(w)})" for w in words)
        + f" THEN {_quote(name)}"
        for name, words in table
    ]
    return f"CASE {' '.join(arms)} ELSE {_quote(D.UNKNOWN)} END"


def _name_sql(user_agent, network):
    head = f"split_part({user_agent}, '/', 1)"
    arms = [
        f"WHEN {_quote(n)} THEN {keyword_case(head, D.CLIENT_WORDS[n])}" for n in D.NETWORKS
    ]
    return f"CASE {network} {' '.join(arms)} ELSE '' END"


def _trim_sql(version):
    """Drop build metadata and pre-release suffix."""
    return f"split_part(split_part({version}, '+', 1), '-', 1)"


def _lotus_sql(user_agent):
    head = f"split_part(split_part({user_agent}, '/', 1), '+', 1)"
    return f"coalesce(try_element_at(split({head}, '-'), 2), {_quote(D.UNKNOWN)})"


def _version_sql(user_agent, network, name):
    places = " ".join(f"WHEN {_quote(c)} THEN {n}" for c, n in D.VERSION_SEGMENT.items())
    piece = f"try_element_at(split({user_agent}, '/'), CASE {name} {places} ELSE 2 END)"
    silent = ", ".join(_quote(c) for c in [D.UNKNOWN, *D.UNVERSIONED_CLIENTS])
    return (
        f"CASE WHEN {name} = '' THEN '' WHEN {name} IN ({silent}) THEN {_quote(D.UNKNOWN)} "
        f"WHEN {network} = {_quote(D.FILECOIN)} THEN {_lotus_sql(user_agent)} "
        f"ELSE {_trim_sql(f'coalesce({piece}, {_quote(D.UNKNOWN)})')} END"
    )


def ua_client_name(user_agent, network):
    return F.expr(_name_sql(user_agent, network))


def ua_client_version(user_agent, network, client_name=None):
    """Version of a recognised client; pass `client_name` if a column has it already."""
    return F.expr(_version_sql(user_agent, network, client_name or _name_sql(user_agent, network)))


def ua_version_lotus(user_agent):
    """Version inside the first segment: `lotus-1.13.0+mainnet` gives `1.13.0`."""
    return F.expr(_lotus_sql(user_agent))


def ua_client_os(user_agent):
    return F.expr(keyword_case(user_agent, D.OS_WORDS))


def ua_client_arch(user_agent):
    return F.expr(keyword_case(user_agent, D.ARCH_WORDS))


def _if_present(user_agent, sql, name):
    return F.expr(f"CASE WHEN {user_agent} IS NOT NULL THEN {sql} END").alias(name)


def with_client(df, user_agent="user_agent", network="network"):
    """Add client_name, client_version, client_os, client_arch; NULL without an agent.

    The version refers to the name's column, so keywords are searched once.
    """
    named = df.withColumn(
        "client_name", _if_present(user_agent, _name_sql(user_agent, network), "client_name")
    )
    return named.select(
        "*",
        _if_present(user_agent, _version_sql(user_agent, network, "client_name"), "client_version"),
        _if_present(user_agent, keyword_case(user_agent, D.OS_WORDS), "client_os"),
        _if_present(user_agent, keyword_case(user_agent, D.ARCH_WORDS), "client_arch"),
    )


def parse_client(user_agent, network):
    """struct(client_name, client_version, client_os, client_arch); NULL agent, NULL struct."""
    parts = {
        "client_name": _name_sql(user_agent, network),
        "client_version": _version_sql(user_agent, network, _name_sql(user_agent, network)),
        "client_os": keyword_case(user_agent, D.OS_WORDS),
        "client_arch": keyword_case(user_agent, D.ARCH_WORDS),
    }
    fields = ", ".join(f"{_quote(n)}, {sql}" for n, sql in parts.items())
    return F.expr(f"CASE WHEN {user_agent} IS NOT NULL THEN named_struct({fields}) END")


def is_identified(user_agent="user_agent", protocol_version="protocol_version", protocols="protocols"):
    return F.expr(
        f"coalesce({user_agent}, '') <> '' OR coalesce({protocol_version}, '') <> '' "
        f"OR coalesce(size({protocols}), 0) > 0"
    )


def latency_ms(nanoseconds):
    """Whole milliseconds, truncated."""
    return F.expr(f"cast({nanoseconds} / 1000000 AS int)")
