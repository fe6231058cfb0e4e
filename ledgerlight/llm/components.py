"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, component): the smallest node reachable. Nodes without an edge do not appear.

    Each round is a few grouped minima and joins on (node, neighbour) rows, saved reliably; nothing reaches the driver
    but a row count and a checksum. Rounds grow with the logarithm of the longest chain.
    """
    pairs = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    seen = _state(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(low, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = materialise(small.union(low.select("hi", F.col("m").alias("lo"))).distinct())
        now = _state(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())
