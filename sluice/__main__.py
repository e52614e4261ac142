"""``python -m sluice flow|search|convert GRAPH -D key=value ...``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.build import both_ways, terminals_of
from sluice.operators.decompose import decompose
from sluice.plans.config import FlowConfig
from sluice.plans.journal import Journal
from sluice.plans.rounds import network, run, search
from sluice.sources import sinks
from sluice.sources.graph import adjacency_figures, dimacs_figures, from_table, parse_adjacency, read_dimacs, read_state

METRICS = "round int, name string, value bigint"


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sluice")
    parser.add_argument("program", choices=["flow", "search", "convert"])
    parser.add_argument("graph", help="adjacency text (plain or gzip), a DIMACS file, or a Parquet table of arcs")
    kind = parser.add_mutually_exclusive_group()
    kind.add_argument("--dimacs", action="store_true")
    kind.add_argument("--table", metavar="SRC,DST[,CAP]", help="columns of a table of directed arcs")
    parser.add_argument("--mode", default="PERMISSIVE", choices=["PERMISSIVE", "FAILFAST"])
    parser.add_argument("--method", default="sweep", choices=["sweep", "paths"])
    parser.add_argument("--out", help="folder for edges, flows, metrics, and paths with --paths; or levels; or arcs")
    parser.add_argument("--paths", action="store_true", help="write the flow's paths as well")
    parser.add_argument("--text", action="store_true", help="write flows, or converted arcs, as text")
    parser.add_argument("-D", action="append", default=[], metavar="KEY=VALUE")
    return parser


def main(argv: list[str] | None = None) -> None:
    parser = arguments()
    args = parser.parse_args(argv)
    config = FlowConfig.parse(dict(x.split("=", 1) for x in args.D))
    if args.program == "convert" and not args.out:
        parser.error("convert needs --out")
    spark = SparkSession.builder.appName("sluice").getOrCreate()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if config.reducers:
        spark.conf.set("spark.sql.shuffle.partitions", str(config.reducers))
    try:
        _run(spark, args, config)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _graph(spark: SparkSession, args: argparse.Namespace, config: FlowConfig) -> tuple[DataFrame, DataFrame | None, FlowConfig, list]:
    """Arcs, terminals if the file names them, the settings, and figures of what was read."""
    if args.dimacs:
        figures = [(0, r["name"], r["value"]) for r in dimacs_figures(spark.read.text(args.graph), args.mode).collect()]
        arcs, terminals, _ = read_dimacs(spark, args.graph)
        return arcs, terminals, replace(config, undirected=False), figures
    if args.table:
        return from_table(spark.read.parquet(args.graph), *args.table.split(",")), None, replace(config, undirected=False), []
    lines = spark.read.text(args.graph)
    return parse_adjacency(lines, args.mode), None, config, [(0, r["name"], r["value"]) for r in adjacency_figures(lines).collect()]


def progress(kind: str, turn: int, figures: dict[str, int], seconds: float) -> None:
    """One line for each round, as it ends."""
    print(f"{kind} {turn}, {seconds:.1f} s:", ", ".join(f"{name} {n}" for name, n in figures.items()), flush=True)


def _run(spark: SparkSession, args: argparse.Namespace, config: FlowConfig) -> None:
    resume = args.program == "flow" and config.resume
    if resume:
        arcs, terminals, figures = None, None, []
    else:
        arcs, terminals, config, figures = _graph(spark, args, config)
    if args.program == "convert":
        if args.text:
            sinks.adjacency_lines(both_ways(arcs) if config.undirected else arcs).write.mode("overwrite").text(args.out)
        else:
            arcs.write.mode("overwrite").parquet(args.out)
    elif args.program == "search":
        starts = terminals_of(spark, config.sources, ()) if terminals is None else terminals.where("kind = 'source'")
        levels, sizes = search(arcs, starts.select(F.col("v")))
        print("vertices by level:", sizes)
        figures += [(d, "vertices", n) for d, n in enumerate(sizes)]
        if args.out:
            sinks.level_lines(levels).write.mode("overwrite").text(f"{args.out}/levels")
    else:
        journal = Journal(spark, f"{args.out}/journal" if args.out and config.commit_every else None, max(1, config.commit_every), config.keep_rounds, config.codec, progress)
        if journal.path and not resume:
            journal.clear()
        edges = read_state(spark, args.graph) if resume else network(arcs, config, terminals)
        result = run(edges, config, args.method, journal)
        print(f"flow {result.value}, cut {result.cut_value}, sweeps {result.sweeps}, {'maximal' if result.converged else 'stopped early'}")
        figures += [*result.metrics, (result.sweeps, "total_flow", result.value)]
        if args.out:
            sinks.write_state(result.edges, f"{args.out}/edges", config.codec)
            sinks.write_flows(result.edges, f"{args.out}/flows", args.text)
            if args.paths:
                sinks.write_paths(decompose(result.edges), f"{args.out}/paths")
    for turn, name, value in figures:
        print(turn, name, value)
    if args.out and args.program != "convert":
        sinks.write_metrics(spark.createDataFrame(figures, METRICS), f"{args.out}/metrics")


if __name__ == "__main__":
    main()
