"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.shared import cut


def _least(edges: DataFrame) -> DataFrame:
    """Each node with the least node of its neighbourhood, itself included."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: long) but the roots; root: the least node that is reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected components in
    MapReduce and beyond"): each is one aggregation and one join, a node's neighbours are never
    gathered, and few rounds suffice whatever the graph's shape; it goes on until a round changes nothing. A hub with very many neighbours
    is a skewed join key with one row at the other side, which AQE splits. Null ends and loops are ignored;
    an empty graph gives an empty table.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.filter("u > v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
