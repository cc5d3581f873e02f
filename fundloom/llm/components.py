"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import Scratch, materialise


def _star(links: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Link neighbours to the least node around: the greater ones (large) or the lesser ones (small).

    The least neighbour is an aggregate with partial sums on the map side, and
    a table of its own, so that Spark can split the join at a node with very
    many links.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()
    least = scratch.table(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    out = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for each node in ``links(a, b)``; component is the least node reachable.

    Nodes are longs. Links have no direction; loops, repeats and rows with a
    null end are dropped, and an empty table gives no rows. Each round is
    written to the shared folder. Rounds end when nothing changes; their
    number grows with the logarithm of the longest chain.
    """
    with Scratch(links.sparkSession, tag) as scratch:
        now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = scratch.table(now, "links")
        mark = F.struct(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)))
        seen = now.agg(mark).first()[0]
        while seen[0]:
            now = scratch.table(_star(_star(now, True, scratch), False, scratch), "round")
            new = now.agg(mark).first()[0]
            if new == seen:
                break
            seen = new
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), tag)
