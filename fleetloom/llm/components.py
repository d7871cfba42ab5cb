"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.durable import discard, durable


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour, or to itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # A node with very many links is a hot key on one side, and unique on the other.
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them. Links point downwards."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Distributed union-find: ``node, root`` for every node that has a link; the root is the smallest node.

    ``links`` has two columns of one orderable type, a row per link, in any direction, repeated or not;
    rows with a NULL and links of a node to itself say nothing. Rounds of two steps hang the links of
    every node on its smallest neighbour until all nodes of a component hang on its smallest node:
    a number of rounds that grows with the logarithm of the longest chain. Every round's links are written
    to the shared folder and the ones before are removed. The driver sees a count and a checksum.
    """
    a, b = links.columns
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    current = durable(pairs.where(F.col("u") != F.col("v")).distinct())
    state = _state(current)
    while state[0]:
        following = durable(_small_star(_large_star(current)))
        discard(current)
        current, before, state = following, state, _state(following)
        if state == before:
            break
    # The roots themselves, too: what hangs on nothing is its own root.
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
