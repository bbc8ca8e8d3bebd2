"""Queries that SQL can express, value by value."""

import glob
import os

import duckdb
import pytest

from peerlens.llm.oracle import ORACLE
from peerlens.llm.queries import QUERIES


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(data, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    expected = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == expected
