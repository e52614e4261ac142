"""Graph construction: one row for each edge, u < v, with a capacity for each direction and the net flow from u to v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.plans.config import SINK, SOURCE, TERMINAL_CAPACITY


def both_ways(arcs: DataFrame) -> DataFrame:
    """Every arc in both directions, from one scan; self-loops go."""
    turned = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return arcs.where("src <> dst").select(F.inline(F.array(F.struct("src", "dst"), turned)))


def symmetrise(arcs: DataFrame) -> DataFrame:
    """Every arc in both directions, once each; self-loops go."""
    return both_ways(arcs).distinct()


def merge_parallel(arcs: DataFrame) -> DataFrame:
    """Edges u, v, cap_uv, cap_vu, flow from directed arcs with capacities; parallel arcs add up, self-loops go."""
    forward = F.col("src") < F.col("dst")
    rows = arcs.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.when(forward, F.col("cap")).otherwise(0).alias("a"), F.when(forward, 0).otherwise(F.col("cap")).alias("b"))
    return rows.groupBy("u", "v").agg(F.sum("a").cast("bigint").alias("cap_uv"), F.sum("b").cast("bigint").alias("cap_vu")).withColumn("flow", F.lit(0).cast("bigint"))


def seeded_capacity(u: Column, v: Column, most: int, seed: int = 0) -> Column:
    """1 to ``most``, the same for an edge in every run."""
    return (F.pmod(F.xxhash64(F.least(u, v), F.greatest(u, v), F.lit(seed)), F.lit(most)) + 1).cast("bigint")


def unit_edges(arcs: DataFrame, most: int = 1, seed: int = 0) -> DataFrame:
    """Undirected edges of unit capacity (or seeded ones up to ``most``) both ways; duplicates and self-loops go."""
    pairs = arcs.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    cap = F.lit(1).cast("bigint") if most <= 1 else seeded_capacity(F.col("u"), F.col("v"), most, seed)
    return pairs.withColumns({"cap_uv": cap, "cap_vu": cap, "flow": F.lit(0).cast("bigint")})


def terminal_arcs(terminals: DataFrame, capacity: int = TERMINAL_CAPACITY) -> DataFrame:
    """Arcs from the super source to each source and from each sink to the super sink; a vertex of both kinds raises."""
    kinds = terminals.select("v", "kind").distinct().groupBy("v").agg(F.count("*").alias("n"), F.first("kind").alias("kind"))
    kind = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("both source and sink: "), F.col("v").cast("string"))).cast("string")).otherwise(F.col("kind"))
    ends = kinds.select("v", kind.alias("kind"))
    is_source = F.col("kind") == "source"
    return ends.select(F.when(is_source, SOURCE).otherwise(F.col("v")).cast("bigint").alias("src"), F.when(is_source, F.col("v")).otherwise(SINK).cast("bigint").alias("dst"), F.lit(capacity).cast("bigint").alias("cap"))


def attach_terminals(edges: DataFrame, terminals: DataFrame, capacity: int = TERMINAL_CAPACITY) -> DataFrame:
    return edges.unionByName(merge_parallel(terminal_arcs(terminals, capacity)))


def terminals_of(spark, sources, sinks) -> DataFrame:
    rows = [(int(v), "source") for v in sources] + [(int(v), "sink") for v in sinks]
    return spark.createDataFrame(rows, "v bigint, kind string")


def degrees(arcs: DataFrame) -> DataFrame:
    """v, degree over outgoing arcs."""
    return arcs.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def pick_terminals(arcs: DataFrame, n: int, least_degree: int, seed: int | None = 0) -> DataFrame:
    """n sources and n sinks among the vertices above a degree, disjoint, in seeded random order (None: by id)."""
    order = [F.col("v")] if seed is None else [F.xxhash64("v", F.lit(seed)), F.col("v")]
    drawn = degrees(arcs).where(F.col("degree") > least_degree).orderBy(*order).limit(2 * n)
    # limit leaves 2n rows whatever the graph's size, so this window is over a bounded table.
    place = F.row_number().over(W.orderBy(*order))
    return drawn.select("v", place.alias("place")).select("v", F.when(F.col("place") % 2 == 1, "source").otherwise("sink").alias("kind"))


def arcs_of(edges: DataFrame) -> DataFrame:
    """The residual arcs src, dst, res with res > 0, from one scan of the edges."""
    forward = F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), (F.col("cap_uv") - F.col("flow")).alias("res"))
    back = F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), (F.col("cap_vu") + F.col("flow")).alias("res"))
    return edges.select(F.inline(F.array(forward, back))).where("res > 0")


def sorted_adjacency(arcs: DataFrame) -> DataFrame:
    """v and its neighbours in ascending order, for output: an adjacency line holds all of a vertex."""
    return arcs.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_set("dst")).alias("near"))
