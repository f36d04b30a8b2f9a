"""Connected components of a graph given as a table of links.

Each round gives every node its least neighbour under a fresh random order and
contracts the links accordingly, which removes a constant share of the nodes;
the mappings of the rounds are joined together at the end. Nothing but the
number of rounds reaches the driver. Round tables are reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with a link to another one.

    Null ends, loops and repeated links count for nothing; no links give an
    empty table. ``root`` is some node of the component, the same for all.
    """
    edges = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b"))
                        .where("a is not null and b is not null and a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        salt = F.lit(len(steps))
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("node"))
        least = both.groupBy("a").agg(F.min(order("b")).alias("best"))
        step = materialize(least.select(F.col("a").alias("node"),
                                        F.least(F.col("best"), order("a"))["node"].alias("to")))
        steps.append(step)
        to_a = step.select(F.col("node").alias("a"), F.col("to").alias("na"))
        to_b = step.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        edges = materialize(edges.join(to_a, "a").join(to_b, "b").where("na <> nb")
                            .select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("to"), "root")
        found = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return found
