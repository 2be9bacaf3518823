"""Connected components of a link table, by alternating large-star and small-star steps.

Links never leave the executors: each step is a grouped minimum (combined map-side, so a hub with a third of all links is
no hot task) and an equi-join that adaptive execution can split. Steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import discard, durable, shuffled

MAX_STEPS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """links(u, v) of longs, in any order and repeated at will -> (node, component): component is the smallest node reachable.

    Only nodes with a link to another node are returned. Nulls and self-links are ignored; an empty table gives an empty one.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, n, stars = _written(edges)
    for _ in range(MAX_STEPS):
        if stars:
            break
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(low), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        old = edges
        edges, n, stars = _written(small, 2 * n)
        discard(old)
    if not stars:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _written(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, int, bool]:
    """-> (edges, their number, whether they are stars: each u has one v, and no v is a u as well, so each v is its component's smallest node)."""
    edges = durable(edges, "links", most)
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    n, stars = ends.agg(F.sum("ups"), F.every((F.col("ups") == 0) | (F.col("n") == 1))).first()
    return edges, n or 0, stars is not False
