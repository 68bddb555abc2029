"""Connected components of a table of edges, without collecting any of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, v) with m, the lowest of u and its neighbours."""
    low = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(low, "u")


def settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: each u has one v, and no v is a u. As v < u, each component then hangs on its lowest node."""
    centers = edges.select(F.col("v").alias("u")).distinct().withColumn("center", F.lit(True))
    return edges.groupBy("u").agg(F.count("*").alias("n")).join(centers, "u", "left").where("n > 1 or center").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the lowest node that can be reached.

    Alternates the large-star and the small-star step: each node hands its larger (then its smaller) neighbours to the
    lowest node it knows. The edges never become more, a hub's edges are dealt over tasks like any others (skewed joins are
    split at run time), and it ends after a logarithmic number of rounds, as soon as only stars are left. Each round is a table that ``keep`` writes.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _lowest(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = keep(small, "edges")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
