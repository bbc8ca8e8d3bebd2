"""Every registered query against its SQL twin, value by value."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry
from peerlens.plans import queries as catalogue

NAMES = sorted(catalogue.queries())
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def ordered(rows, columns, names):
    at = [names.index(c) for c in columns]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def results(spark, data):
    """All queries, a few at a time."""
    def run(name):
        df = entry.queries()[name](spark, data)
        return df.dtypes, [tuple(r) for r in df.collect()]

    with ThreadPoolExecutor(4) as pool:
        futures = {name: pool.submit(run, name) for name in NAMES}
        yield futures


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(data, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(results, sql, name):
    dtypes, rows = results[name].result()
    cursor = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    columns = sorted(n for n, _ in dtypes)
    assert columns == sorted(names)
    assert {n: TYPES[t] for n, t in dtypes} == kinds
    assert ordered(rows, columns, [n for n, _ in dtypes]) == ordered(expected, columns, names)


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["country_code", "cnt"]


def test_bridge_covers_every_case(spark, data):
    from peerlens.operators import distributions, predicates
    from peerlens.plans.queries import AS_OF, Inputs

    b = Inputs(spark, data.replace("0.001", "0.01"))
    peers, ips = b.peers.cache(), b.ips
    for network in [r.network for r in peers.select("network").distinct().collect()]:
        active = predicates.active_peers(peers, AS_OF, network)
        assert active.count() > 0 and active.join(ips, "ip").count() > 0
    for condition in ("deprecated", "last_activity IS NULL", "client_name IS NULL", "latency IS NULL"):
        assert peers.filter(condition).count() > 0
    assert peers.join(ips, "ip", "left_anti").count() > 0
    assert distributions.rtt_distribution(peers, AS_OF).count() == 11
    peers.unpersist()
