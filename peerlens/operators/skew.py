"""Joins that keep a hot key spread over many tasks."""

from pyspark.sql import functions as F

SALTS = 16


def salted_join(large, small, key, spread, how="inner", salts=SALTS):
    """Join where one `key` of `large` may own a large part of its rows.

    `spread` names columns of `large` that vary within a key.  Every row of
    `small` (few rows per key) is repeated once per salt, so a key's rows meet
    it in `salts` tasks.  An aggregation on `key` after the join combines on the
    map side before its shuffle.  A small side that fits a broadcast is still
    broadcast, by its measured size.
    """
    keys = [key] if isinstance(key, str) else list(key)
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
