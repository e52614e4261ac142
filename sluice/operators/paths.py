"""Excess paths: way pieces that grow from the source side (S) and toward the sink (T), meet, and are accepted.

Path tables have v (the growing end), path (array of hops) and bottleneck.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions.graph import PATH, append_hop, empty_path, join_paths, prepend_hop, vertices_of, visits
from sluice.operators.maxflow import UNBOUNDED
from sluice.operators.prefix import carried, prefix_sums
from sluice.plans.arcs import ArcLog
from sluice.plans.scratch import Dealt, Scratch, ship

#: Hops of the candidates that one task goes through in order, about.
LOCAL_HOPS = 1 << 20
#: Stretches of a line at a vertex that each stretch of the other is compared with, at most; longer lines are merged.
FEW_STRETCHES = 8
#: Paths that one task of ``meet`` joins or groups, about; so its memory does not grow with the input.
TASK_PATHS = 1 << 19


def seed_paths(spark: SparkSession, v: int) -> DataFrame:
    """The empty path at a terminal."""
    return spark.range(1).select(F.lit(v).cast("bigint").alias("v"), empty_path().alias("path"), F.lit(UNBOUNDED).alias("bottleneck"))


def extend(paths: DataFrame, arcs: DataFrame, backward: bool = False, longest: int | None = None, draw: int | None = None, most: int | None = None) -> DataFrame:
    """Each path one hop further over arcs with residual capacity; never back to a vertex of the path.

    Forward paths grow at their end along arcs, backward ones at their start against them. longest: hops of a path at
    most. draw: a seed by which one of a vertex's paths is drawn for each arc, instead of all of them. most: paths of a
    vertex at most, if that is known; the draw then looks at lists of them, and arcs stay where they are.
    """
    near, far = ("dst", "src") if backward else ("src", "dst")
    if longest is not None:
        paths = paths.where(F.size("path") < longest)
    if draw is not None and most is not None:
        lists = paths.groupBy(F.col("v").alias(near)).agg(F.collect_list(F.struct("path", "bottleneck")).alias("paths"))
        lot = lambda p: F.struct(F.xxhash64("src", "dst", p["path"], F.lit(draw)).alias("lot"), p["path"].alias("path"), p["bottleneck"].alias("bottleneck"))
        drawn = _least(F.col("paths"), lambda p: ~visits(p["path"], F.col(far)), lot)
        rows = arcs.where("res > 0 AND src <> dst").join(lists, near).select("src", "dst", "res", drawn.alias("drawn")).where("drawn IS NOT NULL").select("src", "dst", "res", "drawn.path", "drawn.bottleneck")
    else:
        rows = paths.join(arcs.where("res > 0"), F.col("v") == F.col(near))
        rows = rows.where((F.col(far) != F.col("v")) & ~visits(F.col("path"), F.col(far)))
    if draw is not None and most is None:
        order = [F.xxhash64("src", "dst", "path", F.lit(draw)), "path"]
        rows = rows.withColumn("drawn", F.row_number().over(W.partitionBy("src", "dst").orderBy(*order))).where("drawn = 1")
    grown = prepend_hop(F.col("path"), F.col("src"), F.col("dst")) if backward else append_hop(F.col("path"), F.col("src"), F.col("dst"))
    return rows.select(F.col(far).alias("v"), grown.alias("path"), F.least("bottleneck", "res").alias("bottleneck"))


def _least(paths: Column, fits: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """The least value of those of ``paths`` that fit, null if none does. Up to two, as most lists have, take no lambda: Spark interprets those."""
    two = F.least(*(F.when(fits(p), value(p)) for p in (F.get(paths, F.lit(0)), F.get(paths, F.lit(1)))))
    return F.when(F.size(paths) <= 2, two).otherwise(F.array_min(F.transform(F.filter(paths, fits), value)))


def _count(paths: Column, fits: Callable[[Column], Column]) -> Column:
    """How many of ``paths`` fit."""
    first, second = (F.when(fits(p), 1).otherwise(0) for p in (F.get(paths, F.lit(0)), F.get(paths, F.lit(1))))
    return F.when(F.size(paths) <= 2, first + second).otherwise(F.size(F.filter(paths, fits))).cast("bigint")


def promising_arcs(paths: DataFrame, arcs: DataFrame, k: int, scratch: Scratch, label: str, backward: bool = False, longest: int | None = None, newest: int = 0) -> tuple[DataFrame, int]:
    """The arcs over which the k best offers of every vertex come; and all offers of paths of ``newest`` hops.

    Of each arc only the best offer is looked at: an offer that is among the k best of its vertex comes over one of
    the k arcs with the best such offers. So an arc costs one narrow row, not one for each path of its vertex.
    """
    near, far = ("dst", "src") if backward else ("src", "dst")
    lists = paths.groupBy(F.col("v").alias(near)).agg(F.collect_list(F.struct("bottleneck", "path")).alias("paths"))

    def fits(p: Column) -> Column:
        return ~visits(p["path"], F.col(far)) & (F.size(p["path"]) < (longest if longest is not None else UNBOUNDED))

    order = _least(F.col("paths"), fits, lambda p: F.struct((-F.least(p["bottleneck"], F.col("res"))).alias("o1"), F.size(p["path"]).alias("o2"), F.xxhash64(p["path"], F.col(far)).alias("o3")))
    new = _count(F.col("paths"), lambda p: fits(p) & (F.size(p["path"]) == newest))
    rows = arcs.where("res > 0 AND src <> dst").join(lists, near).select("src", "dst", "res", new.alias("new"), order.alias("o"))
    seen = Observation()
    # Arcs without an offer come last and go after the cut: a filter before it would be pushed down and look at every list twice.
    first = _first(rows.observe(seen, F.coalesce(F.sum("new"), F.lit(0)).alias("n")), k, [F.asc_nulls_last("o"), near], far)
    rows = scratch.table(first.where("o IS NOT NULL"), label)
    return rows.select("src", "dst", "res"), seen.get["n"]


def not_forwarded(offers: DataFrame, sent: DataFrame) -> DataFrame:
    """Offers (path, v) that the same path has not made to the same vertex before."""
    before = sent.select(F.xxhash64("path").alias("sent_hash"), F.col("v").alias("sent_v"), F.col("path").alias("sent_path"))
    same = (F.xxhash64("path") == F.col("sent_hash")) & (F.col("v") == F.col("sent_v")) & (F.col("path") == F.col("sent_path"))  # sorted by the hash, not hop by hop
    return offers.join(before, same, "left_anti")


def bottlenecks(paths: DataFrame, arcs: DataFrame | ArcLog, most: int = UNBOUNDED) -> DataFrame:
    """Paths with their least residual capacity now; paths with a saturated hop are gone. most: hops of all paths at most."""
    keyed = paths.select("v", "path").distinct()
    hops = keyed.select("v", "path", F.explode("path").alias("h")).select("v", "path", F.col("h.u").alias("src"), F.col("h.v").alias("dst"))
    if isinstance(arcs, ArcLog):
        arcs = arcs.among(hops.select("src", "dst").distinct(), most)
    known = hops.join(arcs, ["src", "dst"], "left").groupBy("v", "path").agg(F.min(F.coalesce("res", F.lit(0))).alias("bottleneck")).where("bottleneck > 0")
    return known.unionByName(keyed.where(F.size("path") == 0).withColumn("bottleneck", F.lit(UNBOUNDED)))


def best_paths(paths: DataFrame, k: int | None) -> DataFrame:
    """The k best paths of each vertex (None: all): larger bottleneck, then shorter, then smaller hops."""
    return _first(paths, k, [F.desc("bottleneck"), F.size("path"), "path"])


def random_paths(paths: DataFrame, k: int | None, seed: int = 0) -> DataFrame:
    """k paths of each vertex (None: all) in seeded random order: that of the MD5 of ``seed:v0:v1:...``."""
    vertices = F.array_join(F.transform(vertices_of(F.col("path")), lambda v: v.cast("string")), ":")
    return _first(paths, k, [F.md5(F.concat(F.lit(f"{seed}:"), vertices)), "path"])


def _first(rows: DataFrame, k: int | None, order: list, key: str = "v") -> DataFrame:
    if k is None:
        return rows
    if k <= int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):  # Spark cuts before it shuffles
        return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= k).drop("place")
    # A salted first cut keeps a vertex with very many rows from meeting in one task whole.
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(32))
    near = rows.withColumn("salt", salt).withColumn("place", F.row_number().over(W.partitionBy(key, "salt").orderBy(*order))).where(F.col("place") <= k)
    return near.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= k).drop("salt", "place")


def meet(s_paths: DataFrame, t_paths: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Whole ways from source to sink where an S and a T path meet, cycles taken out: path, bottleneck."""
    scratch, n = scratch or Scratch(s_paths.sparkSession, "meet"), F.count(F.lit(1))
    s, s_seen = scratch.counted(s_paths.select("v", "path", "bottleneck"), "s", n=n)
    t, t_seen = scratch.counted(t_paths.select("v", F.col("path").alias("t_path"), F.col("bottleneck").alias("t_bottleneck")), "t", n=n)
    tasks = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-(s_seen["n"] + t_seen["n"]) // TASK_PATHS))
    rows = s.repartition(tasks, "v").join(t.repartition(tasks, "v"), "v").select(join_paths(F.col("path"), F.col("t_path")).alias("path"), F.least("bottleneck", "t_bottleneck").alias("bottleneck"))
    return rows.where(F.size("path") > 0).repartition(tasks, "path").groupBy("path").agg(F.min("bottleneck").alias("bottleneck"))


def meet_along_lines(s_paths: DataFrame, t_paths: DataFrame, scratch: Scratch, label: str = "lines", most: int | None = None) -> DataFrame:
    """path, bottleneck of whole ways from source to sink where S and T paths meet, cycles taken out.

    At a vertex the S paths lie along one line and the T paths along another, each as long as its bottleneck, best
    first. Where stretches overlap the two become a way of that much flow, so a vertex gives fewer ways than it has
    paths, and no path more flow than it has. A way that several vertices give counts once, with its most flow. most:
    paths of a vertex on a side at most, if that is known.
    """
    lines, other = [], t_paths
    for side, paths in (("s", s_paths), ("t", t_paths)):  # each of them is made once: the second meets what is left of the first
        own, seen = scratch.counted(paths.join(other.select("v").distinct(), "v", "left_semi"), f"{label}/{side}", n=F.count(F.lit(1)))
        other = own
        if not seen["n"]:
            return own.select("path", "bottleneck")
        widest = most if most is not None else own.groupBy("v").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        lines.append((widest, prefix_sums(own, ["v"], [F.desc("bottleneck"), F.size("path"), "path"], "bottleneck", widest, scratch, f"{label}/{side}-line", out="at")))
    end = (F.col("at") + F.col("bottleneck")).alias("end")
    (s_most, s), (t_most, t) = lines
    if min(s_most, t_most) <= FEW_STRETCHES:  # lines lie as they were summed, and nothing is sorted anew
        t = t.select("v", F.col("path").alias("t_path"), F.col("at").alias("t_at"), end.alias("t_end"))
        held = s.select("v", "path", "at", end).join(t, "v").where("at < t_end AND t_at < end")
        amount = F.least("end", "t_end") - F.greatest("at", "t_at")
    else:
        held, amount = _merged(s, t, s_most + t_most, scratch, label)
    ways = held.select(join_paths(F.col("path"), F.col("t_path")).alias("path"), amount.alias("bottleneck"))
    return ways.where(F.size("path") > 0).groupBy("path").agg(F.max("bottleneck").alias("bottleneck"))


def _merged(s: DataFrame, t: DataFrame, most: int, scratch: Scratch, label: str) -> tuple[DataFrame, Column]:
    """Overlapping stretches of two lines at each vertex, in one pass over both; and how long the overlap is."""
    end, none = (F.col("at") + F.col("bottleneck")).alias("end"), F.lit(None)
    cuts = s.select("v", "at", "path", end, none.cast(PATH).alias("t_path"), none.cast("bigint").alias("t_end"))
    cuts = cuts.unionByName(t.select("v", "at", none.cast(PATH).alias("path"), none.cast("bigint").alias("end"), F.col("path").alias("t_path"), end.alias("t_end")))
    columns = ["path", "end", "t_path", "t_end"]
    cuts = cuts.groupBy("v", "at").agg(*(F.first(c, ignorenulls=True).alias(c) for c in columns))
    held = carried(cuts, ["v"], "at", columns, most, scratch, f"{label}/held").where("at < end AND at < t_end")
    return held, F.least("next", "end", "t_end") - F.col("at")  # least leaves nulls out


#: What a task of ``accept`` gives back: 0, its number of open candidates (low); 1, what an arc's candidates use at
#: least and at most; 2, the rank (src) of a candidate and its amount (low), once none of its range is open.
_TURN = "range bigint, kind int, src bigint, dst bigint, low bigint, high bigint"


def _in_order(hops: pa.Table, before: pa.Table) -> pa.Table:
    """One range of candidates, one after the other, from what all before it use at least and at most (``_TURN``)."""
    rank, src, dst, res, asked = (hops[c].to_numpy() for c in ("rank", "src", "dst", "res", "bottleneck"))
    number, order = hops["range"][0].as_py(), np.argsort(rank, kind="stable")
    (_, u), (ends, v) = (np.unique(np.concatenate([x, before[c].to_numpy()]), return_inverse=True) for x, c in ((src, "src"), (dst, "dst")))
    _, first_of, arc = np.unique(u * len(ends) + v, return_index=True, return_inverse=True)
    arc, earlier, full = arc[: len(src)], arc[len(src) :], res[first_of]
    most, least = full.copy(), full.copy()  # what is left of each arc, at most and at least
    most[earlier] -= before["low"].to_numpy()
    least[earlier] -= before["high"].to_numpy()
    most_left, least_left, arc = most.tolist(), least.tolist(), arc[order].tolist()
    begin = np.flatnonzero(np.diff(rank[order], prepend=-1))
    amounts, open_ = [], 0
    for i, j, want in zip(begin.tolist(), [*begin[1:].tolist(), len(arc)], asked[order][begin].tolist()):
        own, low, high = arc[i:j], want, want
        for a in own:
            if most_left[a] < high:
                high = most_left[a]
            if least_left[a] < low:
                low = least_left[a]
        low = max(low, 0)
        open_ += low < high
        amounts.append(low)
        for a in own:
            most_left[a] -= low
            least_left[a] -= high
    rows = [[0], [0], [0], [open_], [0]], [np.full(len(full), 1), src[first_of], dst[first_of], most - np.array(most_left), np.minimum(least - np.array(least_left), full)]
    if not open_:
        rows = *rows, [np.full(len(begin), 2), rank[order][begin], np.zeros(len(begin)), amounts, np.zeros(len(begin))]
    kind, *columns = (np.concatenate(c).astype(np.int64) for c in zip(*rows))
    return pa.table([pa.array(np.full(len(kind), number)), pa.array(kind, pa.int32()), *map(pa.array, columns)], names=["range", "kind", "src", "dst", "low", "high"])


def accept(candidates: DataFrame, arcs: DataFrame | ArcLog, order: list[Column | str] | None = None, scratch: Scratch | None = None, label: str = "accept") -> DataFrame:
    """path, amount of candidates in order, each given what those accepted before it leave on all its arcs.

    The order is cut into ranges of LOCAL_HOPS hops, a task each. In a turn each range goes through its candidates one
    after the other with two bounds of what every arc has left: all ranges before it take the most they still may, or
    the least they are sure of. So a chain within a range costs no turn, and the first range that is open is settled by
    the next turn at the latest; mostly all are after a few. From turn to turn only what the ranges use of each arc
    goes on; the hops stay in their buckets. An arc that has enough for all who ask binds nobody and is left out. One
    that gets nothing charges nothing. Paths are simple.
    """
    scratch = scratch or Scratch(candidates.sparkSession, "accept")
    order = order or [F.size("path"), "path"]
    found, seen = scratch.counted(candidates.select("path", "bottleneck").where(F.size("path") > 0), f"{label}/candidates", hops=F.coalesce(F.sum(F.size("path")), F.lit(0)))
    if not seen["hops"]:
        return found.select("path", F.col("bottleneck").alias("amount"))
    # Ranges in order, and places within them: the ids ascend with the order.
    ranges = -(-seen["hops"] // max(1, LOCAL_HOPS))
    ranked = found.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranked = scratch.table(ranked.withColumn("rank", F.monotonically_increasing_id()), f"{label}/ranked")
    hops = ranked.select("rank", "bottleneck", F.explode("path").alias("h")).select("rank", "bottleneck", F.col("h.u").alias("src"), F.col("h.v").alias("dst"))
    ship(scratch.spark)
    held, arc, of_range = Dealt(scratch, f"{label}/hops", "range"), ["src", "dst"], F.shiftright("rank", 33).alias("range")
    with scratch.in_buckets():
        tight = hops.groupBy(*arc).agg(F.sum("bottleneck").alias("asked"))
        tight = arcs.among(tight, seen["hops"]) if isinstance(arcs, ArcLog) else tight.join(arcs, arc, "left").withColumn("res", F.coalesce("res", F.lit(0).cast("bigint")))
        tight = scratch.table(tight.where("asked > res").select(*arc, "res"), f"{label}/tight")
    held.add(hops.join(tight, arc).select(of_range, "rank", *arc, "res", "bottleneck"))
    zero, settled, turn = F.lit(0).cast("bigint"), [], 0
    used = held.read().groupBy("range", *arc).agg(zero.alias("low"), F.least(F.sum("bottleneck"), F.max("res")).alias("high"))
    done, open_ = used.where("false"), None
    while open_ is None or open_:
        turn += 1
        rows, earlier = held.read(), W.partitionBy(*arc).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
        before = done.unionByName(used).select("range", *arc, *(F.sum(c).over(earlier).alias(c) for c in ("low", "high"))).where("high > 0")
        if open_ is not None:
            rows, before = rows.where(F.col("range").isin(open_)), before.where(F.col("range").isin(open_))
        out = scratch.table(rows.groupBy("range").cogroup(before.groupBy("range")).applyInArrow(_in_order, _TURN), f"{label}/turn-{turn}")
        left = {r["range"]: r["low"] for r in out.where("kind = 0").select("range", "low").collect()}
        open_ = [number for number, n in left.items() if n]
        used, ended = out.where("kind = 1").select("range", *arc, "low", "high"), ~F.col("range").isin(open_)
        done, used = done.unionByName(used.where(ended)), used.where(~ended)
        settled.append(out.where("kind = 2").select(F.col("src").alias("rank"), F.col("low").alias("amount")))
    held.close(delete=True)
    taken = functools.reduce(DataFrame.unionByName, settled)
    return ranked.join(taken, "rank", "left").select("path", F.coalesce("amount", "bottleneck").alias("amount")).where("amount > 0")


def as_delta(accepted: DataFrame) -> DataFrame:
    """src, dst, flow of all accepted paths."""
    hops = accepted.select(F.explode("path").alias("h"), "amount")
    return hops.groupBy(F.col("h.u").alias("src"), F.col("h.v").alias("dst")).agg(F.sum("amount").cast("bigint").alias("flow"))


def lost_vertices(before: DataFrame, after: DataFrame) -> DataFrame:
    """Vertices whose last path went."""
    return before.select("v").distinct().join(after.select("v").distinct(), "v", "left_anti")


def neighbours_of(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Those with an arc to one of the vertices: they are to offer their paths again."""
    return arcs.join(vertices.select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v")).distinct()
