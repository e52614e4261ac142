"""Breadth-first search in rounds: a frontier joins the arcs, and what was not seen before is the next frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.arcs import ArcLog
from sluice.plans.scratch import Dealt, Scratch

LEVELS = "v bigint, d int"


def bfs_levels(arcs: DataFrame | ArcLog, start: DataFrame, stop: int | None = None, max_depth: int | None = None, scratch: Scratch | None = None, label: str = "bfs") -> tuple[DataFrame, list[int], bool]:
    """v, d of every vertex reached from ``start`` (v); the number of vertices of each level; whether ``stop`` was met.

    Vertices that are not reached are left out. With ``stop`` the search ends after the level that holds it. ``arcs``
    are read at every level: best a table in buckets by src (``Scratch.bucketed``) or an ``ArcLog``, which then stay
    in place.
    """
    scratch = scratch or Scratch(arcs.sparkSession, "bfs")
    goal = F.count_if(F.col("v") == (stop if stop is not None else F.lit(None).cast("bigint")))
    first = start.select(F.col("v").cast("bigint").alias("v"), F.lit(0).alias("d")).distinct()
    seen, depth = Dealt(scratch, label, "v"), 0
    got = seen.counted(first, n=F.count(F.lit(1)), met=goal)
    sizes = [got["n"]]
    while sizes[-1] and not got["met"] and (max_depth is None or depth < max_depth):
        levels = seen.read()
        tails = levels.where(F.col("d") == depth).select(F.col("v").alias("src"))
        depth += 1
        leaving = arcs.rows(tails) if isinstance(arcs, ArcLog) else arcs.join(tails, "src")
        # What is new comes to the buckets of what was seen, which stay; the arcs stay in theirs.
        near = leaving.select(F.col("dst").alias("v")).distinct().join(levels.select("v"), "v", "left_anti")
        got = seen.counted(near.withColumn("d", F.lit(depth)), in_place=True, n=F.count(F.lit(1)), met=goal)
        sizes.append(got["n"])
    if not sizes[-1] and len(sizes) > 1:
        sizes.pop()
    return seen.close(), sizes, got["met"] > 0


def reachable(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """v of every vertex reached."""
    scratch = Scratch(arcs.sparkSession, "reachable")
    return bfs_levels(scratch.bucketed(arcs.select("src", "dst"), "arcs", "src"), start, scratch=scratch)[0].select("v")


def level_histogram(levels: DataFrame) -> DataFrame:
    return levels.groupBy("d").agg(F.count("*").alias("n"))
