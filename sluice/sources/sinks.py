"""Writers and dumps of flow results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.graph import edge_text, path_text
from sluice.operators.build import sorted_adjacency


def write_state(edges: DataFrame, path: str, codec: str = "zstd") -> None:
    """All edges with their flows, to resume from."""
    edges.write.mode("overwrite").option("compression", codec).parquet(path)


def flows(edges: DataFrame) -> DataFrame:
    """u, v, flow of the edges that carry any."""
    return edges.where("flow <> 0").select("u", "v", "flow")


def write_flows(edges: DataFrame, path: str, text: bool = False) -> None:
    """Flows as a table, or as lines ``u v flow``."""
    rows = flows(edges)
    if text:
        rows.select(F.concat_ws(" ", "u", "v", "flow").alias("value")).write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def write_paths(paths: DataFrame, path: str) -> None:
    """Accepted paths as lines v0:v1:...=amount."""
    paths.select(path_text(F.col("path"), F.col("amount")).alias("value")).write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """round, name, value as tab-separated lines with a header."""
    metrics.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def adjacency_lines(arcs: DataFrame) -> DataFrame:
    """Lines ``id <tab> x <tab> neighbour ...``, neighbours ascending."""
    return sorted_adjacency(arcs).select(F.concat_ws("\t", F.col("v"), F.lit("x"), F.array_join(F.transform("near", lambda x: x.cast("string")), "\t")).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(edge_text(F.col("u"), F.col("v"), F.col("flow"), F.col("cap_uv")).alias("value"))


def level_lines(levels: DataFrame) -> DataFrame:
    """``vertex <tab> distance`` lines of a breadth-first search."""
    return levels.select(F.concat_ws("\t", F.col("v"), F.col("d")).alias("value"))


def vertex_dump(edges: DataFrame, v: int) -> DataFrame:
    """The edges of one vertex, seen from it."""
    out = edges.where(F.col("u") == v).select(F.col("v").alias("neighbour"), "flow", F.col("cap_uv").alias("capacity"))
    return out.unionByName(edges.where(F.col("v") == v).select(F.col("u").alias("neighbour"), (-F.col("flow")).alias("flow"), F.col("cap_vu").alias("capacity")))
