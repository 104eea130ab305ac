"""Transitive closure over an edge table."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_checkpoints(rows: DataFrame) -> None:
    """Gives the session of rows a checkpoint folder, if it has none."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # a temporary folder only on a single machine, as in tests
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corroba-"))


def closure(edges: DataFrame, start: DataFrame, max_depth: int = 50) -> DataFrame:
    """Nodes reached from the start nodes over edges (parent, child), with all parents among
    the start nodes and the reached ones. A breadth-first walk: each round joins the frontier
    with the edges and leaves out what was met before, so cycles end."""
    set_checkpoints(edges)
    edges = edges.distinct().checkpoint()
    frontier = start.select("node").distinct()
    met = frontier
    for _ in range(max_depth):
        frontier = edges.join(frontier, edges["parent"] == frontier["node"], "left_semi").select(F.col("child").alias("node")).distinct().join(met, "node", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        met = met.union(frontier).checkpoint()
    else:
        raise RuntimeError("closure deeper than max_depth")
    reached = edges.join(met.withColumnRenamed("node", "parent"), "parent", "left_semi")
    return reached.groupBy(F.col("child").alias("node")).agg(F.collect_set("parent").alias("parents"))
