"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step regroups the edges by node and points neighbours at the smallest node
seen. Only a flag reaches the driver; a hub with a million neighbours is a
pre-aggregated minimum and a join that adaptive execution can split, never a
collected group. Several graphs can be solved in the same rounds: ``by`` names
the columns that tell them apart.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from nestfold.sources.storage import materialize

MAX_ROUNDS = 60


def _smallest(edges: DataFrame, at: list[str]) -> DataFrame:
    return edges.groupBy(*at).agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame, at: list[str]) -> DataFrame:
    """Every larger neighbour points at the smallest one; repeated edges stay for the next step."""
    both = edges.unionByName(edges.withColumns({"u": F.col("v"), "v": F.col("u")}))
    return (
        both.join(_smallest(both, at), at).filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        .select(*at[:-1], F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(down: DataFrame, at: list[str]) -> DataFrame:
    """``down`` has ``u`` above ``v`` in all rows, as the large step leaves them."""
    least = _smallest(down, at)
    return (
        down.join(least, at).filter(F.col("v") != F.col("m")).select(*at[:-1], F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select(*at, F.col("m").alias("v"))).distinct()
    )


def _are_stars(edges: DataFrame, at: list[str]) -> bool:
    """Every node has one edge down, and none of its targets has any: nothing is left to do."""
    ends = edges.select(*at, F.lit(1).alias("down")).unionByName(
        edges.select(*at[:-1], F.col("v").alias("u"), F.lit(0).alias("down")))
    nodes = ends.groupBy(*at).agg(F.sum("down").alias("down"), F.min("down").alias("target"))
    return nodes.filter("down > 1 or (down = 1 and target = 0)").isEmpty()


def connected(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, node, root): the smallest node of its component, for every node but the roots themselves.

    ``edges`` has two long columns ``u`` and ``v`` without nulls, and ``by``. It
    is read more than once, so it should be a written table.
    """
    at = [*by, "u"]
    edges = edges.select(*at, "v").filter("u != v")
    if not edges.isEmpty():
        for _ in range(MAX_ROUNDS):
            edges = materialize(_small_star(_large_star(edges, at), at), "edges")
            if _are_stars(edges, at):
                break
        else:
            raise RuntimeError("components did not settle")
    return edges.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))
