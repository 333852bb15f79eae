"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lookup, table


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Rows (node, component): each node of ``links`` with the smallest node it reaches.

    Large-star and small-star rounds (Kiveris et al., 2014): every round links
    nodes to smaller ones, until all point to the smallest of their component.
    Each round is written to the shared folder, so lineage stays short. Nodes
    without links have no row.
    """
    edges = table(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    mark = _sum(edges)
    for _ in range(most_rounds):
        half = table(_large_star(edges), "links")
        new = table(_small_star(half), "links")
        drop(half)
        drop(edges)
        edges, was, mark = new, mark, _sum(new)
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return table(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("v > u OR u > v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.sum(F.when(F.col("v") > F.col("u"), 1).otherwise(0)).alias("n"))
    return _to_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    inner = _to_least(e, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _to_least(e: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least neighbour of ``u``. A hub's edges are not brought to one task: its row is broadcast."""
    return lookup(e, least.where("n > 0"), ["u"], "n", max(1, e.count()))
