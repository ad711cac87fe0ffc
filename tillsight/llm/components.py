"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = F.explode(
        F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    )
    return edges.select(turned.alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return tied.union(own).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Each node that has an edge with the smallest node it is connected to: node, component.

    Stars are merged in turns until no edge changes, which takes about as many
    rounds as the logarithm of the longest path.  A star's centre may have any
    number of edges: minima are formed before the shuffle, and a join on the
    centre is split by adaptive execution.  Every round's edges are written to
    the shared folder.
    """
    spark = edges.sparkSession
    current = scratch.table(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    state = None
    number = 0
    while True:
        marks = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if marks == state or not marks[0]:
            break
        state, number = marks, number + 1
        current = scratch.table(_small_star(_large_star(current)), f"{name}-{number}")
        scratch.drop(f"{name}-{number - 1}")
    centres = current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres)
