"""Passes of the crawler over its peers, found in the dial log.

A pass is a longest run of attempts, of whatever peers, in which no two neighbours in time are more than `gap` seconds
apart.  Attempts of one slice of `gap` seconds are always in one pass, so a slice is its first and last attempt and a
count, combined on the map side.  Slices are chained block by block, and blocks by one row each: no step orders the log, and
what one task holds is bounded by the covered time.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_SECONDS = 900
#: Slices that are chained in one window partition.
BLOCK_SLICES = 4096


def dial_passes(attempts, gap=GAP_SECONDS):
    """(pass, pass_start, pass_end, attempts, seconds), numbered from 1 in the order of time."""
    gap_us = gap * 1_000_000
    us = F.unix_micros("ts")
    slices = attempts.filter("ts IS NOT NULL").groupBy(F.floor(us / gap_us).alias("slice")).agg(
        F.min(us).alias("first"), F.max(us).alias("last"), F.count(F.lit(1)).alias("n")
    )
    slices = slices.withColumn("block", F.floor(F.col("slice") / BLOCK_SLICES))
    inside = W.partitionBy("block").orderBy("slice")
    slices = slices.withColumn("before", F.lag("last").over(inside))
    # The first slice of a block follows the last one of the block before.
    blocks = W.orderBy("block")
    ends = slices.groupBy("block").agg(F.max("last").alias("end")).select("block", F.lag("end").over(blocks).alias("carried"))
    before = F.coalesce("before", "carried")
    marked = slices.join(ends, "block").withColumn(
        "fresh", F.when(before.isNull() | (F.col("first") - before > gap_us), 1).otherwise(0)
    )
    earlier = blocks.rowsBetween(W.unboundedPreceding, -1)
    offsets = marked.groupBy("block").agg(F.sum("fresh").alias("n_fresh")).select(
        "block", F.coalesce(F.sum("n_fresh").over(earlier), F.lit(0)).alias("offset")
    )
    so_far = F.sum("fresh").over(inside.rowsBetween(W.unboundedPreceding, 0))
    numbered = marked.withColumn("so_far", so_far).join(offsets, "block").withColumn("pass", (F.col("so_far") + F.col("offset")).cast("int"))
    return numbered.groupBy("pass").agg(
        F.timestamp_micros(F.min("first")).alias("pass_start"), F.timestamp_micros(F.max("last")).alias("pass_end"),
        F.sum("n").alias("attempts"), ((F.max("last") - F.min("first")) / F.lit(1_000_000.0)).alias("seconds"),
    )


def last_pass(attempts, gap=GAP_SECONDS):
    """The newest pass as one row; none without attempts."""
    passes = dial_passes(attempts, gap)
    row = F.max_by(F.struct(*passes.columns), "pass").alias("p")
    return passes.agg(row).filter("p IS NOT NULL").select("p.*")


def with_last_pass(retry_state, attempts, gap=GAP_SECONDS):
    """`retry_state` with `in_last_pass`: whether the peer's last attempt belongs to the newest pass."""
    start = last_pass(attempts, gap).select("pass_start")
    return retry_state.withColumn("in_last_pass", F.coalesce(F.col("last_attempt") >= start.scalar(), F.lit(False)))


def attempted_in_last_pass(retry_state, attempts, gap=GAP_SECONDS):
    return with_last_pass(retry_state, attempts, gap).filter("in_last_pass").drop("in_last_pass")
