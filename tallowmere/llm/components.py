"""Connected components by alternating large-star and small-star rounds, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, written


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least of the node and its neighbours."""
    both = _mirrored(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lesser = edges.hint("merge").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lesser.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, list[str]]:
    """Roots of the nodes that ``edges(u, v)`` mention.

    Returns ``(node, root)`` with the least node of the component as root, and the folders that hold
    it.  ``u`` and ``v`` have one orderable type; edges of a node to itself and edges with a null are
    dropped.  No edges give no rows.  A round costs two shuffles of the edges for each of the two
    stars; hubs only pass through partial minima and merge joins on both of whose sides Spark can split a
    large partition; nothing is broadcast, whatever its size.  Rounds grow with the logarithm of the number of nodes.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = written(e)
    before = None
    for _ in range(rounds):
        if e.isEmpty():
            break
        nxt, new = written(_small_star(_large_star(e)))
        removed(spark, path)
        e, path = nxt, new
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(row):
            break
        before = tuple(row)
    else:
        raise RuntimeError("the components have not settled; allow more rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots), [path]
