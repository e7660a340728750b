"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.storage import Scratch, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large-star links every larger neighbour to the smallest one; small-star the smaller neighbours and the node."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    met = around.join(least, "u")
    if large:
        links = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        links = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return links.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of `edges` (u long, v long).

    Each step writes its edges to the shared folder and drops those before, so lineage stays short and lost executors
    cost one step. A node's smallest neighbour is found by partial aggregation, so a star with many leaves isn't gathered
    anywhere; the number of steps grows with the logarithm of the longest path. Only a count and a checksum reach the
    driver. No edges give no nodes; repeated edges and loops don't matter.
    """
    held = Scratch()
    edges = held.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _signature(edges)
    while seen[0]:
        fresh = Scratch()
        edges = fresh.write(_star(_star(edges, True), False), "edges")
        held.clear()
        held, now = fresh, _signature(edges)
        if now == seen:
            break
        seen = now
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = materialize(pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    held.clear()
    return found
