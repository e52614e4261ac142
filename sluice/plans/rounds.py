"""Whole runs: from a graph and settings to a flow with its proof."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.build import arcs_of, attach_terminals, both_ways, merge_parallel, pick_terminals, symmetrise, terminals_of, unit_edges
from sluice.operators.maxflow import FlowResult, ends, max_flow, with_residuals
from sluice.operators.paths import accept, as_delta, best_paths, bottlenecks, extend, lost_vertices, meet_along_lines, neighbours_of, not_forwarded, promising_arcs, random_paths, seed_paths
from sluice.operators.traverse import bfs_levels
from sluice.plans.arcs import ArcLog
from sluice.plans.config import SINK, SOURCE, FlowConfig
from sluice.plans.journal import Journal
from sluice.plans.scratch import Scratch


def network(arcs: DataFrame, config: FlowConfig, terminals: DataFrame | None = None) -> DataFrame:
    """The edge table of a run: capacities, then terminals (given, configured, or picked by degree)."""
    spark = arcs.sparkSession
    if "cap" in arcs.columns and not config.undirected:
        edges = merge_parallel(arcs)
    else:
        edges = unit_edges(arcs, config.max_random_capacity, config.seed)
    if terminals is None and config.random_terminals:
        terminals = pick_terminals(symmetrise(arcs) if config.undirected else arcs, config.random_terminals, config.terminal_degree, config.seed)
    elif terminals is None:
        terminals = terminals_of(spark, config.sources, config.sinks)
    return attach_terminals(edges, terminals)


def solve(arcs: DataFrame, config: FlowConfig, terminals: DataFrame | None = None, method: str = "sweep") -> FlowResult:
    """method: 'sweep', or 'paths' for rounds of meeting excess paths first."""
    return run(network(arcs, config, terminals), config, method)


def run(edges: DataFrame, config: FlowConfig, method: str = "sweep", journal: Journal | None = None) -> FlowResult:
    """The flow over edges, from the flow they carry already (that of a written state, to resume).

    With the journal of a run that broke off, this goes on from its last whole round, of paths or of sweeps.
    """
    rounds: list[tuple[int, str, int]] = []
    if method == "paths" and (journal is None or journal.last("sweeps") is None):
        edges, rounds = path_rounds(edges, config, journal=journal)
    result = max_flow(edges, config.max_rounds, config.approx, config.keep_rounds, journal=journal)
    result.metrics[:0] = rounds
    return result


def path_rounds(edges: DataFrame, config: FlowConfig, rounds: int | None = None, measured: bool = True, journal: Journal | None = None, finished: bool = True) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """Bidirectional rounds: paths grow from both terminals, meet, and are accepted; a valid flow and its metrics.

    Arcs are dealt twice, by their starts and by their ends, and stay there; accepted flow goes to their logs. A path
    is offered to each neighbour once, and again if the neighbour lost its last path; only offers that a neighbour may
    keep are made. Path lists are cut to ``kept_paths`` a vertex, so this may stop short of the maximum; the sweeps
    finish it. Metrics of each side: paths that might be offered (extended), kept, cut off (truncated) and lost to
    saturated arcs, vertices that gained their first path (moves) or lost their last (lost_vertices), and neighbours
    that are to offer again (notified). Without ``measured`` what only metrics need is left out (moves, notified, the
    last turn's losses); the flow is the same. Without ``finished`` the edges come back as they were, for who asks for
    the metrics alone. journal: takes every turn with its path lists and what was sent, and gives back the last whole
    one, to go on from.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "paths")
    before = journal.last("paths") if journal is not None else None
    if before is not None:
        edges = before["tables"]["edges"]
    edges = scratch.table(edges, "edges-0")
    one = F.count(F.lit(1))
    ends_of = {"source": "src", "sink": "dst"}  # a path grows over arcs that have this end at it
    logs = {side: ArcLog(scratch, f"arcs-{key}", arcs_of(edges), key) for side, key in ends_of.items() if side == "source" or config.bidirectional}
    sides = {"source": seed_paths(spark, SOURCE), "sink": seed_paths(spark, SINK)}
    sent: dict[str, DataFrame | None] = {"source": None, "sink": None}
    metrics: list[tuple[int, str, int]] = []
    held, seen = dict.fromkeys(sides, 1), dict.fromkeys(sides, 1)  # paths and vertices of each side
    begun = 0
    if before is not None:
        tables, begun, metrics, held, seen = before["tables"], before["turn"], before["figures"], before["held"], before["seen"]
        tables = {name: scratch.table(df, f"{name}-{begun}") for name, df in tables.items() if name != "edges"}
        sides, sent = {side: tables[side] for side in sides}, {side: tables.get(f"{side}_sent") for side in sides}
    last, flowed, most = config.path_rounds if rounds is None else rounds, False, config.kept_paths
    for turn in range(begun + 1, last + 1):
        for side, paths in sides.items():
            if side not in logs:
                continue
            near = logs[side].rows(paths.select(F.col("v").alias(ends_of[side])).distinct())
            draw, back = config.seed + turn if config.forward == "one" else None, side == "sink"
            possible = None
            if draw is None and most is not None:
                near, possible = promising_arcs(paths, near, most, scratch, f"{side}-arcs-{turn}", back, config.longest_path, turn - 1)
            grow = lambda some: extend(some, near, backward=back, longest=config.longest_path, draw=draw, most=most)  # noqa: B023, E731
            older = None
            if sent[side] is None:
                offers = grow(paths)
            elif draw is not None:
                offers = not_forwarded(grow(paths), sent[side])
            else:  # what was sent before this turn has fewer hops than what its longest paths offer now
                newest = F.size("path") == turn - 1
                offers, older = grow(paths.where(newest)), not_forwarded(grow(paths.where(~newest)), sent[side]).select("v", "path", "bottleneck")
                offers = offers.unionByName(older)
            offers, offered = scratch.counted(offers, f"{side}-offers-{turn}", n=one, old=F.count_if(F.size("path") < turn))
            if possible is not None:
                offered["n"] = possible + offered["old"]
            sent[side] = offers.select("path", "v") if sent[side] is None else sent[side].unionByName(offers.select("path", "v"))
            # No path is twice among these: those kept were sent before, and each arc makes another path of each.
            before, whole = paths.unionByName(offers), held[side] + offered["n"]
            kept = random_paths(before, most, config.seed + turn) if config.path_choice == "random" else best_paths(before, most)
            sides[side], left = scratch.counted(kept, f"{side}-{turn}", n=one)
            reached = sides[side].select("v").distinct().count() if measured else 0
            metrics += [(turn, f"{side}_extended", offered["n"]), (turn, f"{side}_paths", left["n"]), (turn, f"{side}_truncated", whole - left["n"])]
            metrics += [(turn, f"{side}_moves", reached - seen[side])] if measured else []
            held[side], seen[side] = left["n"], reached
        candidates, met = scratch.counted(meet_along_lines(sides["source"], sides["sink"], scratch, f"lines-{turn}", most), f"met-{turn}", n=one)
        got = {"n": 0, "flow": 0}
        if met["n"]:
            taken, got = scratch.counted(accept(candidates, logs["source"], scratch=scratch, label=f"accept-{turn}"), f"accepted-{turn}", n=one, flow=F.coalesce(F.sum("amount"), F.lit(0)))
        metrics += [(turn, "candidates", met["n"]), (turn, "accepted_paths", got["n"]), (turn, "accepted_flow", got["flow"]), (turn, "dropped", met["n"] - got["n"])]
        if got["n"]:
            flowed = True
            delta, changed = scratch.counted(as_delta(taken), f"delta-{turn}", n=one)
            metrics.append((turn, "changed_arcs", changed["n"]))
            for log in logs.values():
                log.change(delta, changed["n"])
            if turn == last and not measured:
                break
            for side, paths in sides.items():
                with scratch.in_buckets():
                    sides[side], left = scratch.counted(bottlenecks(paths, logs["source"], held[side] * turn), f"{side}-left-{turn}", n=one)
                lost, gone = scratch.counted(lost_vertices(paths, sides[side]), f"{side}-lost-{turn}", n=one)
                metrics += [(turn, f"{side}_saturated", held[side] - left["n"]), (turn, f"{side}_lost_vertices", gone["n"])]
                held[side], seen[side] = left["n"], seen[side] - gone["n"]
                if gone["n"] and sent[side] is not None:
                    if turn < last:
                        sent[side] = scratch.table(sent[side].join(lost, "v", "left_anti"), f"{side}-sent-{turn}")
                if gone["n"] and measured:
                    into = logs["sink"].rows(lost.select(F.col("v").alias("dst"))) if "sink" in logs else logs["source"].rows()
                    metrics.append((turn, f"{side}_notified", neighbours_of(into, lost).count()))
        elif not any(n for t, name, n in metrics if t == turn and name.endswith("_extended")):
            break
        if journal is not None:
            with scratch.in_buckets():
                state = lambda: {"edges": with_residuals(edges, logs["source"].rows()), **sides, **{f"{side}_sent": df for side, df in sent.items() if df is not None}}  # noqa: B023, E731
                journal.done("paths", turn, metrics, state, held=held, seen=seen)
        scratch.drop(*(f"{name}-{turn}" for name in ("lines", "met", "accept", "source-arcs", "sink-arcs")))
    if flowed and finished:
        with scratch.in_buckets():
            edges = scratch.table(with_residuals(edges, logs["source"].rows()), "edges")
    for log in logs.values():
        log.close()
    return edges, metrics


def search(arcs: DataFrame, sources: DataFrame) -> tuple[DataFrame, list[int]]:
    """Distances from a super source joined to ``sources`` (v), as levels v, d, over undirected arcs; and level sizes."""
    scratch = Scratch(arcs.sparkSession, "search")
    first = sources.select(F.lit(SOURCE).cast("bigint").alias("src"), F.col("v").cast("bigint").alias("dst"))
    joined = scratch.bucketed(both_ways(arcs).unionByName(first), "arcs", "src", distinct=True)
    levels, sizes, _ = bfs_levels(joined, ends(arcs.sparkSession, SOURCE), scratch=scratch)
    return levels, sizes
