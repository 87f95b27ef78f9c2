"""Connected components of an edge table, without gathering edges or groups anywhere.

Alternating large-star and small-star steps: every node points its neighbours to the
smallest label it sees, by a minimum that is combined on the map side and joined back.
Each step is written to the shared folder, so lineage stays short and a lost executor
costs one step.  The driver sees one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.plans.stage import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """`edges` have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of its component for each node with an edge, roots left out.

    `edges` has the columns u and v of one orderable type.
    """
    current = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links")
    before = None
    for _ in range(max_rounds):
        current = stage(_small_star(_large_star(current).distinct()).distinct(), "links")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
