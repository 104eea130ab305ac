"""Connected components of an undirected graph, as joins and aggregations.

Alternating large-star and small-star steps: every node hangs its larger neighbours, then
its smaller ones, onto its smallest neighbour, until the edges are stars around each
component's smallest node. Edges and labels stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroba.llm._common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
    return both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). One row a node that has an edge to another: node, component, the
    smallest node that it reaches. Self-loops and repeated edges are harmless."""
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = _print(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        edges = materialise(_small_star(materialise(_large_star(edges), "edges")), "edges")
        now = _print(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
