"""Connected components of an edge table, by alternating star contraction.

Every round points each node at the smallest node it touches (large star, then small star), so
long chains shrink fast and the number of edges never grows. A hub with many edges meets its
minimum in a combining aggregate, and the join back to its edges is one that Spark splits when
it is uneven. Rounds are written to the shared folder; nothing is gathered on the driver but
two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.session import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, distinct. Links to the minimum of a node's neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u")
    m = F.least("u", "m")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), m.alias("v"))
        own = least.filter(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), m.alias("v"))
        own = least.select("u", F.col("m").alias("v"))
    return out.unionByName(own).filter(F.col("u") > F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns ``u`` and ``v`` of one orderable type).

    The component is its smallest node. Null ends, loops and repeated edges are ignored; no edges,
    no rows. Fails if ``most_rounds`` rounds do not settle it, rather than returning a part.
    """
    edges = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges = stage(_star(_star(edges, True), False), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # settled: stars only, each node below its component's smallest node
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
