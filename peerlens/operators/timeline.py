"""Neighbour lookups along one key's timeline that survive a hot key.

A window over the key alone would put a key with a third of all rows into one
task.  Here the window runs over (key, time slice); only the rows at slice
borders, at most two per slice, meet in a window over the key.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE_SECONDS = 3600
ORDER = ("ts", "seq")


def time_slice(seconds=SLICE_SECONDS):
    return F.floor(F.unix_timestamp("ts") / seconds)


def with_next(df, key, columns, name="following", slice_seconds=SLICE_SECONDS):
    """Add struct(columns) of the next row of the same key, in (ts, seq) order."""
    sliced = df.withColumn("_slice", time_slice(slice_seconds))
    inner = W.partitionBy(key, "_slice").orderBy(*ORDER)
    row = F.struct(*columns)
    marked = sliced.withColumn(name, F.lead(row).over(inner)).withColumn(
        "_first", F.row_number().over(inner) == 1
    )
    # Interior rows are final.  The last row of a slice looks at the next border row.
    last = F.col(name).isNull()
    border = marked.filter(last | F.col("_first"))
    across = border.withColumn("_carried", F.lead(row).over(W.partitionBy(key).orderBy(*ORDER)))
    closing = across.filter(last).withColumn(name, F.col("_carried")).drop("_carried")
    return marked.filter(~last).unionByName(closing).drop("_slice", "_first")


def with_latest_before(df, key, value, name, slice_seconds=SLICE_SECONDS):
    """Add the greatest non-null `value` among this and all earlier rows of the key."""
    sliced = df.withColumn("_slice", time_slice(slice_seconds)).withColumn("_value", value)
    inner = W.partitionBy(key, "_slice").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    within = sliced.withColumn("_within", F.max("_value").over(inner))
    earlier = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(key, "_slice")
        .agg(F.max("_value").alias("_value"))
        .select(key, "_slice", F.max("_value").over(earlier).alias("_carried"))
    )
    return (
        within.join(carried, [key, "_slice"])
        .withColumn(name, F.greatest("_within", "_carried"))
        .drop("_slice", "_value", "_within", "_carried")
    )
