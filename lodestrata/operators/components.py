"""Connected components of an edge table, by alternating large-star and small-star steps.

The published MapReduce algorithm: each step links vertices to the least neighbour known, and
the edge set becomes one star per component after a number of rounds that grows with the
logarithm of the longest path. Each round is written to the shared folder, so that a lost
executor costs one round and the plan stays small. Nothing is collected but two counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least neighbour of each u; aggregated before the shuffle, so a hub is small."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = _least(down)
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(vertex, component) of every vertex of an edge between different vertices; the component
    is its least vertex. Edges with a null end are left out; vertices that only link to
    themselves, or to nothing, are not listed."""
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v"), "edges")
    mark = None
    for _ in range(max_rounds):
        now = stored(_small_star(_large_star(now)), "stars")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == new:
            break
        mark = new
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
