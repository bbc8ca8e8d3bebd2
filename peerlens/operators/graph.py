"""Routing-table edges and the crawl frontier."""

from functools import reduce

from pyspark.sql import functions as F

from peerlens.sources.tables import bucketed


def neighbour_edges(probes):
    """Distinct peer-to-neighbour edges of the probes that worked."""
    return probes.filter(~F.col("failed")).select("peer", "neighbour").distinct()


def neighbour_errors(probes):
    """Per peer, the bitmask of prefix lengths whose probe failed."""
    bit = F.when(F.col("failed"), F.expr("shiftleft(1, CAST(cpl AS INT))")).otherwise(0)
    return probes.groupBy("peer").agg(F.bit_or(bit).alias("error_bits"))


def crawl_frontier(edges, seeds):
    """Round in which each peer becomes known, seeds in round 0.

    The edges are stored once in buckets by their source, and every round's fresh peers in buckets by peer.  A round joins
    the frontier with the edges and leaves out what earlier rounds know, delta by delta; only the neighbours that the
    frontier reaches are shuffled, once.  The loop ends when no new peer appears.
    """
    edges = bucketed(edges.select("peer", "neighbour"), "peer", "edges")
    deltas = [bucketed(seeds.select("peer").distinct().withColumn("round", F.lit(0)), "peer", "known")]
    while True:
        fresh = reached(edges, deltas[-1])
        for known in deltas:
            fresh = fresh.join(known.select("peer"), "peer", "left_anti")
        frontier = bucketed(fresh.withColumn("round", F.lit(len(deltas))), "peer", "known")
        if frontier.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), deltas)
        deltas.append(frontier)


def reached(edges, frontier):
    """Distinct neighbours of the frontier's peers."""
    return edges.join(frontier.select("peer"), "peer").select(F.col("neighbour").alias("peer")).distinct()
