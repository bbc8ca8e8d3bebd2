"""Reading and writing the eight tables with their declared schemas."""

import os

from pyspark.sql import functions as F

from peerlens.schemas import TABLES
from peerlens.session import run_dir

# Physical layout: the column each table is partitioned by on write.
LAYOUT = {
    "peer_info": ("network", None),
    "conn_events": ("conn_date", "to_date(timestamp_seconds(conn_time))"),
    "eth_attestations": ("arrival_date", "to_date(arrival_time)"),
    "eth_blocks": ("arrival_date", "to_date(arrival_time)"),
}


def load(spark, directory, table, dates=False):
    """One table; no schema inference, so no pass over the files.

    `dates=True` keeps the date column that big tables are partitioned by, for
    callers that prune by date.
    """
    rows = spark.read.schema(TABLES[table]).parquet(os.path.join(directory, table))
    return rows if dates else rows.select(TABLES[table].fieldNames())


def conform(df, table):
    """Project to the declared columns and types; absent columns become NULL."""
    have = set(df.columns)
    return df.select(
        [
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ]
    )


def save(df, directory, table, mode="overwrite"):
    """Write one table in its layout; partition values are spread over writers by AQE."""
    out = conform(df, table)
    path = os.path.join(directory, table)
    column, expression = LAYOUT.get(table, (None, None))
    if column is None:
        out.write.mode(mode).parquet(path)
        return path
    if expression is not None:
        out = out.withColumn(column, F.expr(expression))
    # `rebalance` splits large partition values and merges small ones.
    out.hint("rebalance", column).write.mode(mode).partitionBy(column).parquet(path)
    return path


def bucketed(df, key, name="bucketed"):
    """`df` written once in buckets by `key`, one per shuffle partition, and read from there.

    A join or grouping on `key` moves the other side only.  Where the other side is broadcast, Spark reads the buckets
    as plain files, so a bucket with a very frequent key is split.  The table is named after its folder in the shared
    folder; its entry in the session's catalog ends with the session.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    table = os.path.basename(path).replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)
