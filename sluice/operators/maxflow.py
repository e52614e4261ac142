"""Exact maximum flow by sweeps over level graphs.

A sweep searches the residual graph breadth-first from the source. If the sink is not reached, the reached set is the
minimal minimum cut and the flow is maximal: the exit condition is the proof. Otherwise potentials run back from the
sink (what a vertex could still pass on), the source's inflow is dealt forward by prefix sums, and inflow that found
no way out is trimmed backward. Every allocation respects the residuals and conserves flow, so each sweep gains, as
long as any way is left in the level graph; then the next search begins.

A level graph is swept by joins, or, where it is small, by one task; sweep for sweep the two give the same flow, so
values, counts, limits and figures do not depend on which of them ran. The arcs of a run are exchanged once (``ArcLog``);
what a level graph gained is added to their log.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.build import arcs_of
from sluice.operators import prefix
from sluice.operators.blocks import Limit, block_in_memory, flow_in_blocks
from sluice.operators.prefix import prefix_sums
from sluice.operators.traverse import bfs_levels
from sluice.plans.arcs import ArcLog
from sluice.plans.config import SINK, SOURCE
from sluice.plans.journal import Journal
from sluice.plans.scratch import Dealt, Scratch, ship

UNBOUNDED = (1 << 63) - 1
#: Levels that one plan may span.
LAZY_DEPTH = 8
#: A level graph with no more arcs (32 MB) is swept by one task; larger ones by joins, until no more are left that the
#: source still reaches. Either way the sweeps are the same.
LOCAL_ARCS = 1 << 20
#: So many vertices that are still reached at a level go to all tasks (8 MB); where there are more, their arcs come to them.
NEAR_VERTICES = 1 << 20
#: A graph of more edges is first solved block by block (``flow_in_blocks``), if no limit of sweeps is set.
WHOLE_EDGES = 1 << 20


@dataclass
class FlowResult:
    """Edges with flows (written when first asked for), the source side of the minimum cut, and the run's figures."""

    write_edges: Callable[[], DataFrame]
    cut_side: DataFrame | None
    value: int
    cut_value: int | None
    sweeps: int
    converged: bool
    metrics: list[tuple[int, str, int]] = field(default_factory=list)

    @functools.cached_property
    def edges(self) -> DataFrame:
        return self.write_edges()

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.value, self.cut_value, self.sweeps, self.converged)], "flow_value bigint, cut_value bigint, sweeps int, converged boolean")

    def metrics_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.metrics, "round int, name string, value bigint")


def ends(spark: SparkSession, v: int) -> DataFrame:
    return spark.range(1).select(F.lit(v).cast("bigint").alias("v"))


def hubs(arcs: DataFrame) -> dict[int, int]:
    """The vertices of more arcs (in either direction) than one task takes in order, and how many: few, since each has so many."""
    both = arcs.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return {r["v"]: r["n"] for r in both.where(F.col("n") > prefix.WHOLE_KEY).collect()}


def most_by_level(levels: DataFrame, degrees: dict[int, int]) -> dict[int, int]:
    """The largest degree of the hubs of each level; a level without a hub is left out."""
    most: dict[int, int] = {}
    for r in levels.where(F.col("v").isin(list(degrees))).collect() if degrees else ():
        most[r["d"]] = max(most.get(r["d"], 0), degrees[r["v"]])
    return most


def level_arcs(arcs: DataFrame | ArcLog, levels: DataFrame, depth: int, sink: int = SINK) -> DataFrame:
    """level, src, dst, res of the arcs from each level to the next, dealt by dst; into the last level only those to the sink."""
    tail = levels.where(F.col("d") < depth).select(F.col("v").alias("src"), F.col("d").alias("level"))
    head = levels.where((F.col("d") < depth) | (F.col("v") == sink)).select(F.col("v").alias("dst"), (F.col("d") - 1).alias("before"))
    leaving = arcs.rows(tail) if isinstance(arcs, ArcLog) else arcs.join(tail, "src")
    buckets = int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return leaving.repartition(buckets, "dst").join(head, "dst").where("level = before").select("level", "src", "dst", "res")


def sweep(graph: DataFrame, depth: int, most: int | Mapping[int, int], scratch: Scratch, label: str, source: int = SOURCE, sink: int = SINK) -> tuple[DataFrame, int, DataFrame]:
    """level, src, dst, flow: a flow through the level graph that uses at least one whole way; its value; v of the vertices that lead on.

    A graph in buckets by dst stays in them, and so does its flow. What a vertex can pass on is a row for each vertex;
    arcs are exchanged once to be dealt by src, and those that take flow once more to be trimmed by dst. Each pass is
    one plan over all levels where these are few, whose shuffles Spark reuses; deep graphs are written level by level,
    so that plans stay small. most: the largest degree, or that of each level where one is large.
    """
    names = []
    widest = [most if isinstance(most, int) else most.get(k, 0) for k in range(depth + 1)]

    def keep(df: DataFrame, name: str, key: str | None) -> DataFrame:
        names.append(f"{label}/{name}")
        return scratch.table(df, names[-1]) if key is None else scratch.bucketed(df, names[-1], key)

    def one_pass(name: str, order, step, key: str | None = None, last_pass: bool = False) -> dict[int, DataFrame]:
        """The rows of every level, each from those of the level before in this pass; the caller writes the last one's."""
        rows: dict[int, DataFrame] = {}
        last = None
        for k in order:
            rows[k] = last = step(k, last) if depth <= LAZY_DEPTH else keep(step(k, last), f"{name}-{k}", key)
        if rows and depth <= LAZY_DEPTH and not last_pass:
            whole = keep(by_level(rows), name, key)
            rows = {k: whole.where(F.col("level") == k).drop("level") for k in rows}
        return rows

    def by_level(rows: dict[int, DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, (df.withColumn("level", F.lit(k)) for k, df in rows.items()))

    def alive(k: int, passed_on: DataFrame) -> DataFrame:
        p = passed_on.select(F.col("v").alias("dst"), "p")
        return graph.where(F.col("level") == k).join(p, "dst").select("src", "dst", F.least("res", "p").alias("cap"))

    last = ends(scratch.spark, sink).select("v", F.lit(UNBOUNDED).alias("p"))
    potential = one_pass("potential", range(depth - 1, 0, -1), lambda k, after: alive(k, last if after is None else after).groupBy(F.col("src").alias("v")).agg(F.sum("cap").alias("p")))
    potential[depth] = last
    onward = functools.reduce(DataFrame.unionByName, (p.select("v") for p in potential.values()))
    first = alive(0, potential[1])
    if first.isEmpty():  # no way is left
        return first.select(F.lit(0).alias("level"), "src", "dst", F.col("cap").alias("flow")), 0, onward

    def forward(k: int, before: DataFrame | None) -> DataFrame:
        if before is None:  # the source gives what its arcs can pass on
            return first.select("src", "dst", F.col("cap").alias("flow"))
        x = before.groupBy(F.col("dst").alias("src")).agg(F.sum("flow").alias("x"))
        rows = prefix_sums(alive(k, potential[k + 1]).join(x, "src"), ["src"], ["dst"], "cap", widest[k], scratch, f"{label}/dealt-sums-{k}")
        return rows.select("src", "dst", F.greatest(F.lit(0), F.least(F.col("cap"), F.col("x") - F.col("before"))).cast("bigint").alias("flow")).where("flow > 0")

    dealt = one_pass("dealt", range(depth), forward, "dst")

    def trim(k: int, after: DataFrame | None) -> DataFrame:
        if after is None:
            return dealt[k]
        passed = after.groupBy(F.col("src").alias("dst")).agg(F.sum("flow").alias("x"))
        rows = prefix_sums(dealt[k].join(passed, "dst"), ["dst"], ["src"], "flow", widest[k + 1], scratch, f"{label}/kept-sums-{k}")
        return rows.select("src", "dst", F.greatest(F.lit(0), F.least(F.col("flow"), F.col("x") - F.col("before"))).cast("bigint").alias("flow")).where("flow > 0")

    kept = one_pass("kept", range(depth - 1, -1, -1), trim, "dst", last_pass=True)
    gained = F.coalesce(F.sum(F.when(F.col("src") == source, F.col("flow"))), F.lit(0))
    out = Dealt(scratch, f"{label}/flow", "dst")
    in_place = max(widest[1:depth], default=0) <= prefix.WHOLE_KEY  # sums in ranges leave the buckets
    got = out.counted(by_level(kept).select("level", "src", "dst", "flow"), in_place=in_place, gained=gained)
    scratch.drop(*(n for n in names if not n.startswith(f"{label}/potential")))
    return out.close(), got["gained"], onward


def _block(batches, limit: Limit, depth: int):
    """Used arcs, then what each sweep gained, as level -1."""
    arcs = [np.concatenate(c) for c in zip(*([np.asarray(x) for x in b.columns] for b in batches))]
    if arcs:
        flow, gains = block_in_memory(*arcs, limit, depth)
        used, turns = flow > 0, np.arange(len(gains))
        rows = [*(c[used] for c in arcs[:3]), flow[used]], [np.full(len(gains), -1), turns, turns, np.array(gains, np.int64)]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for columns in rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["level", "src", "dst", "flow"])


def reached_arcs(graph: DataFrame, depth: int, scratch: Scratch, label: str) -> tuple[DataFrame, int]:
    """The arcs of a level graph that ways from its first level come to, and their number; no sweep uses any other.

    The graph and the result lie in buckets by dst; only the vertices that are reached go about, or, where these are
    many, the arcs of their level.
    """
    held, size, near, reached = Dealt(scratch, label, "dst"), 0, None, 0
    for k in range(depth):
        rows, local = graph.where(F.col("level") == k), reached <= NEAR_VERTICES
        if near is not None:
            rows = rows.join(F.broadcast(near) if local else near, "src", "left_semi").select(graph.columns)
        size += held.counted(rows, in_place=local, n=F.count(F.lit(1)))["n"]
        if k + 1 < depth:
            heads = held.read().where(F.col("level") == k).select(F.col("dst").alias("src")).distinct()
            near, seen = scratch.counted(heads, f"{label}-heads/{k}", n=F.count(F.lit(1)))
            reached = seen["n"]
    return held.close(), size


def level_flow(graph: DataFrame, size: int, depth: int, most: int | Mapping[int, int], scratch: Scratch, label: str, source: int = SOURCE, sink: int = SINK, limit: Limit | None = None, local_arcs: int | None = None) -> tuple[DataFrame, int, list[int]]:
    """level, src, dst, flow: what sweeps send through a level graph of ``size`` arcs; its rows; what each sweep gained.

    The sweeps end when no way is left or the limit is reached. most: the largest degree, or that of each level where
    one is large. Between sweeps by joins, arcs go that lead nowhere or that the source no longer reaches; what is small
    enough then is swept to its end by one task.
    """
    limit, gains = limit or Limit(), []
    if size <= (LOCAL_ARCS if local_arcs is None else local_arcs):
        ship(scratch.spark)
        rows = graph.select("level", "src", "dst", "res").repartition(1).mapInArrow(functools.partial(_block, limit=limit, depth=depth), "level int, src bigint, dst bigint, flow bigint")
        rows, seen = scratch.counted(rows, f"{label}/block", n=F.count_if(F.col("level") >= 0))
        gains = [r["flow"] for r in rows.where("level < 0").orderBy("src").select("flow").collect()]
        return rows.where("level >= 0"), seen["n"], gains
    flows, left = [], graph
    while True:
        turn = len(gains)
        flow, gained, onward = sweep(left, depth, most, scratch, f"{label}/{turn}", source, sink)
        if gained:
            gains.append(gained)
            flows.append(flow)
        if not gained or limit.reached(gains):
            break
        keys = ["level", "src", "dst"]
        left = left.join(onward.withColumnRenamed("v", "dst"), "dst", "left_semi").join(flow, keys, "left").select(*keys, (F.col("res") - F.coalesce("flow", F.lit(0))).alias("res"))
        with scratch.in_buckets():
            left, size = reached_arcs(left.where("res > 0"), depth, scratch, f"{label}/{turn}/reached")
        if not size:
            break
        if size <= (LOCAL_ARCS if local_arcs is None else local_arcs):
            rest = Limit(None if limit.sweeps is None else limit.sweeps - len(gains), limit.approx, limit.value + sum(gains))
            flow, _, more = level_flow(left, size, depth, most, scratch, f"{label}/{turn}/rest", source, sink, rest, local_arcs)
            flows.append(flow)
            gains += more
            break
    if not flows:
        return flow, 0, gains
    whole = functools.reduce(DataFrame.unionByName, flows).groupBy("level", "src", "dst").agg(F.sum("flow").alias("flow"))
    whole, seen = scratch.counted(whole, f"{label}/whole", n=F.count(F.lit(1)))
    scratch.drop(*(f"{label}/{turn}" for turn in range(len(gains) + 1)))
    return whole, seen["n"], gains


def apply_flow(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """Edges after a change given as directed flows src, dst, flow."""
    signed = F.when(F.col("src") < F.col("dst"), F.col("flow")).otherwise(-F.col("flow"))
    change = delta.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), signed.alias("change")).groupBy("u", "v").agg(F.sum("change").alias("change"))
    return edges.join(change, ["u", "v"], "left").select("u", "v", "cap_uv", "cap_vu", (F.col("flow") + F.coalesce("change", F.lit(0))).cast("bigint").alias("flow"))


def flow_value(edges: DataFrame, source: int = SOURCE) -> int:
    """Net flow out of the source."""
    out = F.when(F.col("u") == source, F.col("flow")).when(F.col("v") == source, -F.col("flow")).otherwise(0)
    return edges.where((F.col("u") == source) | (F.col("v") == source)).agg(F.coalesce(F.sum(out), F.lit(0))).first()[0]


def cut_capacity(edges: DataFrame, side: DataFrame) -> int:
    """Capacity of the arcs that leave a vertex set."""
    left = side.select(F.col("v").alias("u"), F.lit(1).alias("in_u"))
    right = side.select("v", F.lit(1).alias("in_v"))
    rows = edges.join(left, "u", "left").join(right, "v", "left")
    leaving = F.when(F.col("in_u").isNotNull() & F.col("in_v").isNull(), F.col("cap_uv")).when(F.col("in_v").isNotNull() & F.col("in_u").isNull(), F.col("cap_vu")).otherwise(0)
    return rows.agg(F.coalesce(F.sum(leaving), F.lit(0))).first()[0]


def with_residuals(edges: DataFrame, arcs: DataFrame) -> DataFrame:
    """The edges with the flow that their residual arcs show."""
    left = arcs.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), "res")
    flow = F.col("cap_uv") - F.coalesce("res", F.lit(0))
    return edges.join(left, ["u", "v"], "left").select("u", "v", "cap_uv", "cap_vu", flow.cast("bigint").alias("flow"))


def max_flow(edges: DataFrame, max_rounds: int | None = None, approx: float = 0.0, keep_rounds: bool = False, source: int = SOURCE, sink: int = SINK, scratch: Scratch | None = None, local_arcs: int | None = None, journal: Journal | None = None) -> FlowResult:
    """Maximum flow from ``source`` to ``sink`` over edges u, v, cap_uv, cap_vu, flow, starting from the flow given.

    max_rounds or approx may stop earlier, after a sweep; the result then is a valid flow but not converged, without a
    cut. keep_rounds: keep the level graphs and flows of all phases. local_arcs: in place of LOCAL_ARCS; 0 for joins only.
    journal: takes every phase, and gives back the last whole one of an earlier run, to go on from.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "maxflow")
    before = journal.last("sweeps") if journal is not None else None
    if before is not None:
        edges = before["tables"]["edges"]
    in_blocks: list[int] = []
    edges, held = scratch.counted(edges.select("u", "v", *(F.col(c).cast("bigint") for c in ("cap_uv", "cap_vu", "flow"))), "edges-0", n=F.count(F.lit(1)))
    if held["n"] > WHOLE_EDGES and before is None and max_rounds is None and not approx:
        edges, in_blocks = flow_in_blocks(edges, held["n"], scratch, "blocks", source, sink)
    # Arcs back may open later, so both directions of an edge count for a vertex's degree.
    degrees = hubs(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    arcs = ArcLog(scratch, "arcs", arcs_of(edges))
    value, metrics, turn, phase = flow_value(edges, source), [], 0, 0
    if before is not None:
        metrics, turn = before["figures"], before["turn"]
    metrics += [(turn, "block_flow", gained) for gained in in_blocks]

    def now() -> DataFrame:
        return with_residuals(edges, arcs.rows())

    def result(side: DataFrame | None) -> FlowResult:
        def final() -> DataFrame:
            with scratch.in_buckets():
                return scratch.table(now(), "edges") if phase else edges

        return FlowResult(final, side, value, None if side is None else cut_capacity(edges, side), turn, side is not None, metrics)

    while True:
        levels, sizes, met = bfs_levels(arcs, ends(spark, source), stop=sink, scratch=scratch, label=f"levels-{phase}")
        depth = len(sizes) - 1
        metrics += [(turn, "visited", sum(sizes)), (turn, "depth", depth)]
        if not met:
            return result(levels.select("v"))
        if max_rounds is not None and turn >= max_rounds:
            return result(None)
        # Sweeps over one level graph until no way is left in it: only then are levels made anew.
        dealt, most = Dealt(scratch, f"graph-{phase}", "dst"), most_by_level(levels, degrees)
        size = dealt.counted(level_arcs(arcs, levels, depth, sink), in_place=True, n=F.count(F.lit(1)))
        graph = dealt.close()
        limit = Limit(None if max_rounds is None else max_rounds - turn, approx, value)
        flow, used, gains = level_flow(graph, size["n"], depth, most, scratch, f"flow-{phase}", source, sink, limit, local_arcs)
        for gained in gains:
            value, turn = value + gained, turn + 1
            metrics += [(turn, "accepted_flow", gained), (turn, "flow_value", value)]
        arcs.change(flow.select("src", "dst", "flow"), used)
        if not keep_rounds:
            scratch.drop(f"levels-{phase}", f"graph-{phase}", f"flow-{phase}")
        phase += 1
        if journal is not None:
            with scratch.in_buckets():
                journal.done("sweeps", turn, metrics, lambda: {"edges": now()})
        if gains[-1] < approx * value:
            return result(None)
