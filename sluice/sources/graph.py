"""Readers of graphs: adjacency text, DIMACS files, edge tables, written flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.graph import fold_id
from sluice.plans.config import RESERVED


def parse_adjacency(lines: DataFrame, mode: str = "PERMISSIVE", column: str = "value") -> DataFrame:
    """src, dst from lines ``id <tab> ignored <tab> neighbour ...``; self-loops are left out.

    PERMISSIVE skips neighbours that are no vertex ids; FAILFAST raises on them and on a neighbour listed twice in a
    line. A bad vertex id always raises. Lines may be as wide as they like.
    """
    fields = F.split(F.col(column), "\t")
    rows = lines.where(F.length(F.trim(F.col(column))) > 0).select(fold_id(F.get(fields, F.lit(0))).alias("src"), F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0))).alias("near"))
    if mode.upper() == "FAILFAST":
        twice = F.size(F.array_distinct("near")) < F.size("near")
        rows = rows.withColumn("near", F.when(twice, F.raise_error(F.lit("a neighbour is listed twice")).cast("array<string>")).otherwise(F.col("near")))
        return rows.select("src", fold_id(F.explode("near")).alias("dst")).where("src <> dst")
    arcs = rows.select("src", F.explode("near").alias("raw")).select("src", fold_id(F.col("raw"), check=False).alias("dst"))
    return arcs.where("dst IS NOT NULL AND dst NOT IN (0, 1, 2) AND dst BETWEEN -2147483648 AND 2147483647 AND src <> dst")


def read_adjacency(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Adjacency text, plain or gzip."""
    return parse_adjacency(spark.read.text(path), mode)


def adjacency_figures(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, value: what PERMISSIVE reading takes and leaves out, so that nothing goes unsaid.

    lines, isolated (lines without any neighbour; their vertices are no part of the graph), neighbours, and of these
    malformed, reserved, out_of_range, self_loops and listed_twice (kept, as parallel arcs).
    """
    fields = F.split(F.col(column), "\t")
    rows = lines.where(F.length(F.trim(F.col(column))) > 0).select(fold_id(F.get(fields, F.lit(0)), check=False).alias("src"), F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0))).alias("near"))
    ids = F.transform("near", lambda x: fold_id(x, check=False))
    count = lambda keep: F.coalesce(F.sum(F.size(F.filter("ids", keep))), F.lit(0)).cast("bigint")
    far = lambda x: (x < -(1 << 31)) | (x >= 1 << 31)
    sums = {
        "lines": F.count("*"), "isolated": F.count_if(F.size("near") == 0), "neighbours": F.coalesce(F.sum(F.size("near")), F.lit(0)).cast("bigint"),
        "malformed": count(lambda x: x.isNull()), "reserved": count(lambda x: x.isin(*RESERVED)), "out_of_range": count(far), "self_loops": count(lambda x: x == F.col("src")),
        "listed_twice": F.coalesce(F.sum(F.size("near") - F.size(F.array_distinct("near"))), F.lit(0)).cast("bigint"),
    }
    found = rows.withColumn("ids", ids).agg(*(c.alias(k) for k, c in sums.items()))
    return found.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in sums))))


def parse_dimacs(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Arcs (src, dst, cap), terminals (v, kind) and the problem line (kind, vertices, arcs) of DIMACS max-flow text.

    File ids move up by 2, so they never meet the reserved ids. Self-loops are left out; parallel arcs stay rows. A
    terminal that is neither ``s`` nor ``t`` raises.
    """
    parts = lines.select(F.split(F.trim(F.col(column)), " +").alias("f"))
    number = lambda i: F.get("f", F.lit(i)).cast("bigint")
    kind = F.get("f", F.lit(0))
    arcs = parts.where(kind == "a").select((number(1) + 2).alias("src"), (number(2) + 2).alias("dst"), number(3).alias("cap")).where("src <> dst")
    side = F.get("f", F.lit(2))
    end = F.when(side == "s", F.lit("source")).when(side == "t", F.lit("sink")).otherwise(F.raise_error(F.concat(F.lit("neither source nor sink: "), F.coalesce(side, F.lit("null")))).cast("string"))
    terminals = parts.where(kind == "n").select((number(1) + 2).alias("v"), end.alias("kind"))
    problem = parts.where(kind == "p").select(F.get("f", F.lit(1)).alias("kind"), number(2).alias("vertices"), number(3).alias("arcs"))
    return arcs, terminals, problem


def dimacs_figures(lines: DataFrame, mode: str = "PERMISSIVE", column: str = "value") -> DataFrame:
    """name, value: what the problem line states beside what the file holds; FAILFAST raises where they differ.

    problem_lines, vertices_stated and arcs_stated (0 without a problem line), arcs (lines, self-loops included), and
    vertex_largest, the largest id of the file.
    """
    f = F.split(F.trim(F.col(column)), " +")
    number, kind = lambda i: F.get(f, F.lit(i)).cast("bigint"), F.get(f, F.lit(0))
    zero = F.lit(0).cast("bigint")
    sums = {
        "problem_lines": F.count_if(kind == "p"), "vertices_stated": F.coalesce(F.max(F.when(kind == "p", number(2))), zero), "arcs_stated": F.coalesce(F.max(F.when(kind == "p", number(3))), zero),
        "arcs": F.count_if(kind == "a"), "vertex_largest": F.coalesce(F.max(F.when(kind == "a", F.greatest(number(1), number(2))).when(kind == "n", number(1))), zero),
    }
    found = lines.agg(*(c.alias(k) for k, c in sums.items()))
    if mode.upper() == "FAILFAST":
        wrong = (F.col("problem_lines") != 1) | (F.col("arcs") != F.col("arcs_stated")) | (F.col("vertex_largest") > F.col("vertices_stated"))
        told = F.format_string("the problem line states %d vertices and %d arcs, the file has %d arcs and vertices up to %d", "vertices_stated", "arcs_stated", "arcs", "vertex_largest")
        found = found.withColumn("arcs", F.when(wrong, F.raise_error(told).cast("bigint")).otherwise(F.col("arcs")))
    return found.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in sums))))


def read_dimacs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_dimacs(spark.read.text(path))


def from_table(df: DataFrame, src: str, dst: str, cap: str | None = None) -> DataFrame:
    """src, dst, cap (1 if not given) of any table; rows with a null end are left out, ids that are no vertices raise."""
    ends = {a: F.when(F.col(b).isNotNull(), fold_id(F.col(b).cast("string"))).alias(a) for a, b in (("src", src), ("dst", dst))}
    rows = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return rows.select(*ends.values(), (F.col(cap).cast("bigint") if cap else F.lit(1).cast("bigint")).alias("cap"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Edges with flows as written by ``sinks.write_state``."""
    return spark.read.parquet(path)
