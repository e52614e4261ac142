"""Connected components of an edge table by alternating large-star and small-star steps.

No step gathers a component: labels move by minimum aggregates, which combine before the shuffle, and joins, whose
large keys adaptive execution splits. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, task


def find(parent: dict, x):
    """Root of x in a union-find forest, halving the path."""
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(pairs) -> list[tuple[int, int]]:
    """(node, smallest node) for each node that hangs on a smaller one."""
    parent: dict = {}
    for a, b in pairs:
        ra, rb = find(parent, a), find(parent, b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(x, r) for x in list(parent) if (r := find(parent, x)) != x]


@task
def _contract(batches):
    """The stars of the edges of a block; equal components, fewer edges and shorter ways."""
    for batch in batches:
        stars = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*stars)], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b); nodes without an edge are left out."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.table(edges.mapInArrow(_contract, "a long, b long").distinct(), "edges-0")
    before, turn = None, 0
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == before or not seen["n"]:
            break
        before, turn = (seen["n"], seen["s"]), turn + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, f"large-{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = scratch.table(small.distinct(), f"edges-{turn}")
        scratch.drop(f"large-{turn}", f"edges-{turn - 1}")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select("component").distinct().select(F.col("component").alias("node"), "component"))
