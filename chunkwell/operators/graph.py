"""Connected components of links between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.functions.storage import release, stored

SALTS = 64


def _with_least(links: DataFrame) -> DataFrame:
    """Links (a, b) with ``m``, the least of a and its partners. A node's links are dealt to SALTS keys, for the minimum and for the join, so that no node is one task's."""
    rows = links.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    part = rows.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = part.groupBy("a").agg(F.least(F.min("m"), F.col("a")).alias("m"))
    return rows.join(part.select("a", "s").join(least, "a"), ["a", "s"]).drop("s")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link (columns a, b of one sortable type): large-star and small-star steps until nothing changes.

    Every round writes its links to the shared folder and deletes those of the round before and its shuffle files; a count and a checksum reach the driver.
    Rounds go on until the links no longer change, about as many as the logarithm of the longest path. No links give no rows.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), free=True)
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # every node's partners are now smaller, and go to the least of them with the node itself
        small = _with_least(large.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        old, edges = edges, stored(small.where("a <> b").distinct(), free=True)
        release(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()

