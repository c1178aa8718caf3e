"""Connected components of an edge table, by alternating large and small stars.

Every step is a grouped minimum and a join, so a centre with a third of all edges is a
skewed join and not a collected list, and nothing reaches the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): each node u that has an edge and isn't its component's least node, with that node v."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), name)
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
    state = mark(now)
    while state[0]:
        then = materialize(_small(_large(now)), name)
        new = mark(then)
        now = then
        if new == state:
            break
        state = new
    return now
