"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.storage import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node in a link (a, b); the root is the component's smallest node.

    Large-star and small-star steps (Kiveris et al., 2014) shorten every path until
    each component is a star, which is seen from the links alone: no further round
    is needed to find that nothing changes. A node's neighbours are only ever reduced
    to their minimum, so a hub of many links is aggregated before the shuffle. Each
    round is written to the shared folder. Links of a node to itself are left out.
    """
    edges = materialize(links.selectExpr("greatest(a, b) x", "least(a, b) y").where("x <> y").distinct(), "links")
    for _ in range(rounds):
        if _stars(edges):
            break
        both = edges.unionByName(edges.selectExpr("y x", "x y"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).selectExpr("x", "least(x, m) m")
        large = both.join(least, "x").where("y > x").selectExpr("y x", "m y").where("x <> y").distinct()
        lower = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lower, "x").selectExpr("y x", "m y").where("x <> y").unionByName(lower.selectExpr("x", "m y")).distinct()
        edges = materialize(small, "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.selectExpr("x node", "y root").unionByName(edges.selectExpr("y node", "y root").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger ones, or larger ones only."""
    ends = edges.selectExpr("x node", "1 up", "0 down").unionByName(edges.selectExpr("y node", "0 up", "1 down"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()
