"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield import session


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step. Edges (u, v) have u > v; the number of edges never grows."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    met = large.join(least, "u")
    small = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", "m")).distinct()


def _sign(edges: DataFrame):
    """Count and order-free hash of the edges: equal for equal sets."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge to another node.

    ``edges`` may repeat, point either way, hold loops (ignored) and nulls (an edge with a null end is no edge). Each round is
    cut to the shared folder; a node with very many edges is met by partial minima and by a join that adaptive
    execution splits, never gathered.
    """
    found = session.cut(edges.select(a, b))
    edges = (
        found.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where("_a IS NOT NULL AND _b IS NOT NULL AND u > v")
        .select("u", "v")
        .distinct()
    )
    edges = session.cut(edges)
    session.free(found)
    sign = _sign(edges)
    while sign[0]:
        after = session.cut(_stars(edges))
        session.free(edges)
        edges, last, sign = after, sign, _sign(after)
        if sign == last:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
