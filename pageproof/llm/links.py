"""Connected components of links between ids, by random contraction.

In each round every id that still has a link looks at itself and its neighbours
and moves to the one that a hash of the round puts first; links are redrawn
between where their ends have moved, and those within one id vanish. A round
removes a constant share of the ids on average, however long chains are, so few
rounds are needed. Moves are folded by joins, never gathered: a hub with any
number of links only ever takes part in a minimum and in joins that Spark can
split. Every round is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageproof.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in ``edges`` (a, b): the smallest id reachable.
    Loops and repeated links don't matter; an empty frame gives an empty one."""
    links = stored(edges.select("a", "b").where("a <> b").distinct())
    moved: DataFrame | None = None
    rounds = 0
    while not links.isEmpty():
        rounds += 1
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = F.struct(F.xxhash64("b", F.lit(rounds)).alias("h"), F.col("b").alias("id"))
        own = F.struct(F.xxhash64("a", F.lit(rounds)).alias("h"), F.col("a").alias("id"))
        first = both.groupBy("a").agg(F.min(place).alias("m"))
        step = stored(first.select("a", F.least("m", own)["id"].alias("to")))
        left = step.select("a", F.col("to").alias("x"))
        right = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        links = links.join(left, "a").join(right, "b").where("x <> y")
        links = stored(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if moved is None:
            moved = step.select(F.col("a").alias("id"), "to")
        else:
            onward = step.select(F.col("a").alias("to"), F.col("to").alias("further"))
            moved = moved.join(onward, "to", "left").select("id", F.coalesce("further", "to").alias("to"))
            moved = stored(moved)
    if moved is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = moved.groupBy("to").agg(F.min("id").alias("component"))
    return moved.join(least, "to").select("id", "component")
