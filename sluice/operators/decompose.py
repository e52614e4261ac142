"""Decomposition of a flow into source-to-sink paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.graph import PATH, append_hop, empty_path
from sluice.operators import prefix
from sluice.operators.maxflow import ends, hubs, level_arcs, level_flow, most_by_level
from sluice.operators.prefix import carried, prefix_sums
from sluice.operators.traverse import bfs_levels
from sluice.plans.arcs import ArcLog
from sluice.plans.config import SINK, SOURCE
from sluice.plans.scratch import Dealt, Scratch


def split_level_flow(flow: DataFrame, depth: int, most: Mapping[int, int], size: int, scratch: Scratch, label: str, source: int = SOURCE) -> DataFrame:
    """path, amount of a flow through a level graph.

    Every vertex lays its inflow and its outflow along one line, cut where either begins a new piece; each piece of
    inflow goes where the outflow on the same stretch goes. So there are no more pieces than inflows and outflows.
    most: the largest degree of each level, where one is large; size: arcs of the level graph, so pieces of a vertex at most.
    """
    total = flow.where((F.col("level") == 0) & (F.col("src") == source)).agg(F.sum("flow").alias("amount"))
    parts = total.where("amount > 0").select(F.lit(source).cast("bigint").alias("src"), empty_path().alias("path"), "amount")
    none = F.lit(None)
    for k in range(depth):
        out = prefix_sums(flow.where(F.col("level") == k).select("src", "dst", "flow"), ["src"], ["dst"], "flow", most.get(k, 0), scratch, f"{label}/out-{k}")
        if size > prefix.WHOLE_KEY:
            parts = scratch.table(parts, f"{label}/parts-{k}")
            widest = parts.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        else:
            widest = 0
        line = prefix_sums(parts, ["src"], ["path"], "amount", widest, scratch, f"{label}/in-{k}")
        cuts = line.select("src", F.col("before").alias("at"), (F.col("before") + F.col("amount")).alias("end"), "path", none.cast("bigint").alias("dst"))
        cuts = cuts.unionByName(out.select("src", F.col("before").alias("at"), (F.col("before") + F.col("flow")).alias("end"), none.cast(PATH).alias("path"), "dst"))
        cuts = cuts.groupBy("src", "at").agg(F.max("end").alias("end"), F.max("dst").alias("dst"), F.first("path", ignorenulls=True).alias("path"))
        held = carried(cuts, ["src"], "at", ["path", "dst"], widest + most.get(k, 0), scratch, f"{label}/held-{k}").withColumn("next", F.coalesce("next", "end"))
        parts = held.select(F.col("dst").alias("src"), append_hop(F.col("path"), F.col("src"), F.col("dst")).alias("path"), (F.col("next") - F.col("at")).alias("amount"))
    return parts.select("path", "amount")


def decompose(edges: DataFrame, source: int = SOURCE, sink: int = SINK) -> DataFrame:
    """round, path, amount: paths that carry the whole value of the flow; circulations are left out."""
    spark = edges.sparkSession
    scratch = Scratch(spark, "decompose")
    turned = F.col("flow") < 0
    used = edges.where("flow <> 0").select(F.when(turned, F.col("v")).otherwise(F.col("u")).alias("src"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("dst"), F.abs("flow").alias("res"))
    used, held = scratch.counted(used, "flow", n=F.count(F.lit(1)))
    arcs, degrees, turn = ArcLog(scratch, "arcs", used), hubs(used), 0
    found = spark.createDataFrame([], "round int, path array<struct<u:bigint,v:bigint>>, amount bigint")
    while True:
        levels, sizes, met = bfs_levels(arcs, ends(spark, source), stop=sink, scratch=scratch, label=f"levels-{turn}")
        if not met:
            arcs.close()
            return found
        depth = len(sizes) - 1
        dealt, most = Dealt(scratch, f"graph-{turn}", "dst"), most_by_level(levels, degrees)
        size = dealt.counted(level_arcs(arcs, levels, depth, sink), in_place=True, n=F.count(F.lit(1)))
        graph, whole = dealt.close(), not turn and size["n"] == held["n"]
        if whole:  # all of the flow lies between the levels, so it is what sweeps would send
            flow, used = graph.select("level", "src", "dst", F.col("res").alias("flow")), size["n"]
        else:
            flow, used, _ = level_flow(graph, size["n"], depth, most, scratch, f"flow-{turn}", source, sink)
        paths = scratch.table(split_level_flow(flow, depth, most, size["n"], scratch, f"split-{turn}", source).withColumn("round", F.lit(turn)).select("round", "path", "amount"), f"paths-{turn}")
        found = found.unionByName(paths)
        if whole:
            arcs.close()
            return found
        arcs.change(flow.select("src", "dst", "flow"), used, back=False)
        turn += 1
