"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cyclelake.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u").where(F.col("v") > F.col("u"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every node and its smaller neighbours on the smallest of them (edges lead from larger to smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, one: str, other: str) -> DataFrame:
    """(node, root) of every linked node; root is the smallest node of its component.

    Each round is written to the shared folder, which cuts the lineage. The number of rounds grows
    with the logarithm of the longest chain. Links of a node to itself and repeated links are allowed.
    """
    pair = links.where(F.col(one) != F.col(other))
    edges = stored(pair.select(F.greatest(one, other).alias("u"), F.least(one, other).alias("v")))
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
