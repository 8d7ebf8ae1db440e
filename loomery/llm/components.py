"""Connected components by alternating large-star and small-star steps.

Both steps are a minimum per vertex (summed map-side) joined back to the edges, so a
vertex with very many neighbours is split like any skewed join; nothing is gathered on
the driver but two numbers per round that tell whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.util import cut


def _star(directed: DataFrame, keep: str) -> DataFrame:
    """Hang each listed neighbour of ``u`` on the smallest of ``u`` and its neighbours."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = directed.join(least, "u")
    moved = near.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved, least


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (u, v: longs); the component is its smallest vertex.

    Null ends, loops and repeated edges are ignored.
    """

    def tidy(frame: DataFrame) -> DataFrame:
        return frame.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(frame: DataFrame) -> tuple:
        row = frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return tuple(row)

    now = cut(tidy(edges))
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved, _least = _star(both, "v > u")
        large = tidy(moved)
        moved, least = _star(large, "true")
        now = cut(tidy(moved.unionByName(least.select("u", F.col("m").alias("v")))))
        if (after := mark(now)) == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    vertex = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return vertex.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
