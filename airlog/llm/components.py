"""Connected components of a graph that lies in a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlog.llm.common import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of the graph with the links (a, b), as rows (node, component).

    component is the smallest node reachable; it has no row itself, nor have nodes without a link to another node. Links of a node to itself,
    repeated links and links with a null end say nothing. An empty table of links gives an empty table.

    Each round hangs every larger neighbour of a node on the node's smallest neighbour, then every smaller neighbour of a node
    and the node itself on the smallest of them, until nothing changes: all components are stars then. A node's smallest
    neighbour is a minimum, combined before its shuffle, and joined back; no node's neighbours are ever gathered in one row.
    Every round is written to the shared folder, so a lost executor costs one round at most. The driver sees one count and one
    checksum a round.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    current = written(ends.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
    state = _state(current)
    for _ in range(rounds):
        both = current.select(F.col("high").alias("node"), F.col("low").alias("other")).unionAll(
            current.select(F.col("low").alias("node"), F.col("high").alias("other")))
        nearest = both.groupBy("node").agg(F.min("other").alias("other")).select(
            F.col("node").alias("low"), F.least("node", "other").alias("least"))
        hung = current.join(nearest, "low").select("high", F.col("least").alias("low")).distinct()
        smallest = hung.groupBy("high").agg(F.min("low").alias("least"))
        stars = hung.join(smallest, "high").where("low <> least").select(
            F.col("low").alias("high"), F.col("least").alias("low")).unionAll(
            smallest.select("high", F.col("least").alias("low"))).distinct()
        current, before = written(stars, "links"), state
        state = _state(current)
        if state == before:
            return current.select(F.col("high").alias("node"), F.col("low").alias("component"))
    raise RuntimeError(f"components did not settle within {rounds} rounds")
