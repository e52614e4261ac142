"""Registered graph queries over the supplier-part tables, and DuckDB SQL for those that SQL can express.

GA: undirected unit edges supplier-part; sources are suppliers 0 modulo 4, sinks 1 modulo 4.
GB: source -> supplier -> part -> sink, directed, with capacities from quantities and sizes.
GC: source -> region -> nation -> customer -> sink, a tree whose flow has a closed form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.graph import fold_id, path_text
from sluice.operators.build import arcs_of, attach_terminals, degrees, merge_parallel, pick_terminals, symmetrise, unit_edges
from sluice.operators.decompose import decompose
from sluice.operators.maxflow import FlowResult, max_flow
from sluice.operators.paths import accept, best_paths, bottlenecks, extend, meet, meet_along_lines, random_paths, seed_paths
from sluice.operators.traverse import level_histogram, reachable
from sluice.operators.verify import capacity_violations, conservation_violations
from sluice.plans.arcs import ArcLog
from sluice.plans.config import SINK, SOURCE, TERMINAL_CAPACITY, FlowConfig
from sluice.plans.rounds import path_rounds, search
from sluice.plans.scratch import Scratch
from sluice.sources.graph import parse_adjacency, parse_dimacs

SUPPLIER, CUSTOMER, PART = 1_000_000, 2_000_000, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ids(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + SUPPLIER).alias("src"), (F.col("l_partkey") + PART).alias("dst"), F.col("l_quantity").cast("bigint").alias("cap"))


def _terminals(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 4 == 0, "source").otherwise("sink")
    return table(spark, sf_dir, "supplier").where("s_suppkey % 4 < 2").select((F.col("s_suppkey") + SUPPLIER).alias("v"), kind.alias("kind"))


def graph_a(spark, sf_dir) -> DataFrame:
    return attach_terminals(unit_edges(_ids(spark, sf_dir)), _terminals(spark, sf_dir))


def graph_b(spark, sf_dir) -> DataFrame:
    quantity = _ids(spark, sf_dir)
    first = quantity.groupBy(F.col("src").alias("dst")).agg(F.floor(F.sum("cap") / 2).cast("bigint").alias("cap")).withColumn("src", F.lit(SOURCE).cast("bigint"))
    last = table(spark, sf_dir, "part").select((F.col("p_partkey") + PART).alias("src"), F.lit(SINK).cast("bigint").alias("dst"), (F.col("p_size") * 10).cast("bigint").alias("cap"))
    return merge_parallel(quantity.unionByName(first).unionByName(last))


def graph_c(spark, sf_dir) -> DataFrame:
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    make = lambda df, src, dst, cap: df.select((F.lit(src) if isinstance(src, int) else src).cast("bigint").alias("src"), (F.lit(dst) if isinstance(dst, int) else dst).cast("bigint").alias("dst"), cap.cast("bigint").alias("cap"))
    region, nation, customer = F.col("n_regionkey") + 10, F.col("n_nationkey") + 100, F.col("c_custkey") + CUSTOMER
    tops = make(people.groupBy("n_regionkey").count(), SOURCE, region, F.col("count") * 4400)
    middles = make(people.groupBy("n_regionkey", "n_nationkey").count(), region, nation, F.col("count") * 4500)
    leaves = make(people, nation, customer, F.greatest(F.floor("c_acctbal"), F.lit(0)))
    ends = make(people, customer, SINK, F.lit(TERMINAL_CAPACITY))
    return merge_parallel(tops.unionByName(middles).unionByName(leaves).unionByName(ends))


def _value(spark, result: FlowResult) -> DataFrame:
    return result.summary(spark)


def edge_build(spark, sf_dir):
    return unit_edges(_ids(spark, sf_dir))


def degree(spark, sf_dir):
    return degrees(symmetrise(_ids(spark, sf_dir)))


def symmetrised(spark, sf_dir):
    return symmetrise(_ids(spark, sf_dir))


def _sources(spark, sf_dir):
    return _terminals(spark, sf_dir).where("kind = 'source'").select("v")


def bfs_levels(spark, sf_dir):
    return search(_ids(spark, sf_dir), _sources(spark, sf_dir))[0]


def bfs_level_histogram(spark, sf_dir):
    return level_histogram(search(_ids(spark, sf_dir), _sources(spark, sf_dir))[0])


def reachable_set(spark, sf_dir):
    """What one supplier can reach in GB."""
    return reachable(arcs_of(graph_b(spark, sf_dir)), spark.range(1).select(F.lit(SUPPLIER + 1).cast("bigint").alias("v")))


def terminal_pick(spark, sf_dir):
    return pick_terminals(symmetrise(_ids(spark, sf_dir)), 10, 5, seed=None)


def capacity_merge(spark, sf_dir):
    return merge_parallel(_ids(spark, sf_dir))


def _half_used(spark, sf_dir):
    """GB with every third edge saturated, to have residuals in both directions."""
    return graph_b(spark, sf_dir).withColumn("flow", F.when((F.col("u") + F.col("v")) % 3 == 0, F.col("cap_uv")).otherwise(F.lit(0).cast("bigint")))


def residual_arcs(spark, sf_dir):
    return arcs_of(_half_used(spark, sf_dir))


def _text(paths: DataFrame) -> DataFrame:
    return paths.select("v", path_text(F.col("path"), F.col("bottleneck")).alias("path"))


def _arcs_b(spark, sf_dir) -> DataFrame:
    """GB's arcs, written once for all steps that read them."""
    return Scratch(spark, "gb").table(arcs_of(graph_b(spark, sf_dir)), "arcs")


def _two_hops(spark, sf_dir, arcs: DataFrame | None = None) -> DataFrame:
    """Excess paths from the source over the supplier to each part of GB."""
    arcs = arcs_of(graph_b(spark, sf_dir)) if arcs is None else arcs
    return extend(extend(seed_paths(spark, SOURCE), arcs), arcs)


def one_hop_extend(spark, sf_dir):
    return _text(_two_hops(spark, sf_dir))


def topk_paths(spark, sf_dir):
    return _text(best_paths(_two_hops(spark, sf_dir), 3))


def random_k_paths(spark, sf_dir):
    return _text(random_paths(_two_hops(spark, sf_dir), 2, seed=7))


def saturated_filter(spark, sf_dir):
    return _text(bottlenecks(_two_hops(spark, sf_dir), arcs_of(_half_used(spark, sf_dir))))


def two_hop_meet(spark, sf_dir):
    arcs = _arcs_b(spark, sf_dir)
    ways = meet(_two_hops(spark, sf_dir, arcs), extend(seed_paths(spark, SINK), arcs, backward=True))
    return ways.select(path_text(F.col("path"), F.col("bottleneck")).alias("path"))


def greedy_acceptance(spark, sf_dir):
    arcs = _arcs_b(spark, sf_dir)
    return accept(_two_hops(spark, sf_dir, arcs), arcs).select(path_text(F.col("path"), F.col("amount")).alias("path"))


def exact_acceptance(spark, sf_dir):
    """Whole ways of GB, by supplier and part, each given what those accepted before it leave on all its arcs."""
    arcs = _arcs_b(spark, sf_dir)
    ways = meet(_two_hops(spark, sf_dir, arcs), extend(seed_paths(spark, SINK), arcs, backward=True))
    return accept(ways, arcs).select(path_text(F.col("path"), F.col("amount")).alias("path"))


def two_line_meet(spark, sf_dir):
    """Ways of GB where the paths to a part share, best first, what its way to the sink can carry."""
    arcs = _arcs_b(spark, sf_dir)
    ways = meet_along_lines(_two_hops(spark, sf_dir, arcs), extend(seed_paths(spark, SINK), arcs, backward=True), Scratch(spark, "meet"))
    return ways.select(path_text(F.col("path"), F.col("bottleneck")).alias("path"))


def tree_flow_by_joins(spark, sf_dir):
    """The flow of GC with every sweep by joins, whatever the size of its level graphs; edges of the two upper levels."""
    edges = max_flow(graph_c(spark, sf_dir), local_arcs=0).edges
    return edges.where((F.col("u") == SOURCE) | (F.col("v") < CUSTOMER) & (F.col("u") > SINK)).groupBy((F.col("u") == SOURCE).alias("upper")).agg(F.sum("flow").alias("flow_value"))


def arc_log_scan(spark, sf_dir):
    """Residual arcs of GB as its log shows them after every third edge took what it can: base and changes, in place."""
    log = ArcLog(Scratch(spark, "log"), "arcs", arcs_of(graph_b(spark, sf_dir)))
    used = _half_used(spark, sf_dir).where("flow > 0").select(F.col("u").alias("src"), F.col("v").alias("dst"), "flow")
    log.change(used, used.count())
    return log.rows()


def adjacency_scan(spark, sf_dir):
    lines = _ids(spark, sf_dir).groupBy("src").agg(F.concat_ws("\t", F.collect_set(F.col("dst").cast("string"))).alias("near"))
    return parse_adjacency(lines.select(F.concat_ws("\t", "src", F.lit("x"), "near", "src", F.lit("bad")).alias("value")))


def dimacs_scan(spark, sf_dir):
    lines = _ids(spark, sf_dir).select(F.format_string("a %d %d %d", "src", "dst", "cap").alias("value"))
    head = spark.range(1).select(F.explode(F.array(F.lit("c made from a table"), F.lit("p max 2 1"), F.lit("n 5 s"))).alias("value"))
    return merge_parallel(parse_dimacs(head.unionByName(lines))[0])


def folded_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fold_id(F.lit(10**14) + F.col("c_custkey") + 3).alias("id"))


def tree_max_flow(spark, sf_dir):
    result = max_flow(graph_c(spark, sf_dir))
    return spark.createDataFrame([(result.value,)], "flow_value bigint")


def max_flow_unit(spark, sf_dir):
    return _value(spark, max_flow(graph_a(spark, sf_dir)))


def max_flow_capacitated(spark, sf_dir):
    return _value(spark, max_flow(graph_b(spark, sf_dir)))


def min_cut_side(spark, sf_dir):
    return max_flow(graph_b(spark, sf_dir)).cut_side


def flow_metrics(spark, sf_dir):
    return max_flow(graph_b(spark, sf_dir)).metrics_table(spark)


def flow_paths(spark, sf_dir):
    """GB's flow as paths, and their sum checked against the value by the caller's tests."""
    paths = decompose(max_flow(graph_b(spark, sf_dir)).edges)
    return paths.select("round", path_text(F.col("path"), F.col("amount")).alias("path"), "amount")


def path_round_flow(spark, sf_dir):
    """Bidirectional path rounds on GA, finished by sweeps; the value must equal that of max_flow_unit."""
    edges, _ = path_rounds(graph_a(spark, sf_dir), FlowConfig(kept_paths=4), rounds=3, measured=False)
    return _value(spark, max_flow(edges))


def path_round_tree_flow(spark, sf_dir):
    """The same with one drawn path for each arc on GC, whose flow has a closed form."""
    edges, _ = path_rounds(graph_c(spark, sf_dir), FlowConfig(kept_paths=8, path_choice="random", forward="one"), rounds=4, measured=False)
    return spark.createDataFrame([(max_flow(edges).value,)], "flow_value bigint")


def tree_cut_side(spark, sf_dir):
    """Vertices of GC on the source side of the minimum cut."""
    return max_flow(graph_c(spark, sf_dir)).cut_side


def tree_flow_edges(spark, sf_dir):
    """Flow into each region of GC: the flow of a tree is unique where it is limited above."""
    edges = max_flow(graph_c(spark, sf_dir)).edges
    return edges.where(F.col("u") == SOURCE).select("v", "flow")


def path_round_metrics(spark, sf_dir):
    rows = path_rounds(graph_b(spark, sf_dir), FlowConfig(kept_paths=2), rounds=3, finished=False)[1]
    return spark.createDataFrame(rows, "round int, name string, value bigint")


def flow_conservation(spark, sf_dir):
    return conservation_violations(max_flow(graph_b(spark, sf_dir)).edges).agg(F.count("*").alias("violations"))


def flow_capacity(spark, sf_dir):
    return capacity_violations(max_flow(graph_b(spark, sf_dir)).edges).agg(F.count("*").alias("violations"))


def duality_gap(spark, sf_dir):
    result = max_flow(graph_b(spark, sf_dir))
    return spark.createDataFrame([(result.cut_value - result.value,)], "violations bigint")


def queries() -> dict:
    every = (edge_build, degree, symmetrised, bfs_levels, bfs_level_histogram, reachable_set, terminal_pick, capacity_merge, residual_arcs, one_hop_extend, topk_paths, random_k_paths, saturated_filter, two_hop_meet, greedy_acceptance, exact_acceptance, two_line_meet, tree_flow_by_joins, arc_log_scan, adjacency_scan, dimacs_scan, folded_ids, tree_max_flow, tree_cut_side, tree_flow_edges, max_flow_unit, max_flow_capacitated, min_cut_side, flow_metrics, flow_paths, path_round_flow, path_round_tree_flow, path_round_metrics, flow_conservation, flow_capacity, duality_gap)
    return {f.__name__: f for f in every}


_E = "e AS (SELECT DISTINCT 1000000 + l_suppkey AS u, 4000000 + l_partkey AS v FROM lineitem)"
_A = f"{_E}, a AS (SELECT u AS src, v AS dst FROM e UNION ALL SELECT v, u FROM e)"
_BFS = f"""WITH RECURSIVE {_A},
  s AS (SELECT src, dst FROM a UNION ALL SELECT 1, 1000000 + s_suppkey FROM supplier WHERE s_suppkey % 4 = 0),
  b(v, d) AS (SELECT 1::BIGINT, 0 UNION SELECT s.dst, b.d + 1 FROM b JOIN s ON s.src = b.v WHERE b.d < 6),
  l AS (SELECT v, CAST(min(d) AS INTEGER) AS d FROM b GROUP BY v)"""
_GB = """q AS (SELECT 1000000 + l_suppkey AS src, 4000000 + l_partkey AS dst, CAST(sum(l_quantity) AS BIGINT) AS cap FROM lineitem GROUP BY 1, 2),
  f AS (SELECT 1 AS src, src AS dst, CAST(floor(sum(cap) / 2) AS BIGINT) AS cap FROM q GROUP BY src),
  t AS (SELECT 4000000 + p_partkey AS src, 2 AS dst, CAST(p_size * 10 AS BIGINT) AS cap FROM part),
  g AS (SELECT * FROM q UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t)"""
_P2 = f"""{_GB}, p AS (SELECT q.dst AS v, f.dst AS s, q.dst AS part, least(f.cap, q.cap) AS b FROM f JOIN q ON q.src = f.dst WHERE f.cap > 0 AND q.cap > 0)"""
_TREE = """cu AS (SELECT c_custkey, c_nationkey, greatest(CAST(floor(c_acctbal) AS BIGINT), 0) AS cap FROM customer),
  na AS (SELECT n_nationkey, n_regionkey, count(c_custkey) AS n, least(coalesce(sum(cap), 0), 4500 * count(c_custkey)) AS f
         FROM nation LEFT JOIN cu ON c_nationkey = n_nationkey GROUP BY 1, 2),
  re AS (SELECT n_regionkey, least(sum(f), 4400 * sum(n)) AS f, sum(n) AS n FROM na GROUP BY 1 HAVING sum(n) > 0)"""
_USED = "CASE WHEN (least(src, dst) + greatest(src, dst)) % 3 = 0 THEN CASE WHEN src < dst THEN cap ELSE 0 END ELSE 0 END"

_RESIDUAL = f"WITH {_GB}, w AS (SELECT src, dst, cap, {_USED} AS flow, CASE WHEN src < dst THEN cap ELSE 0 END AS c1, CASE WHEN src < dst THEN 0 ELSE cap END AS c2, least(src, dst) AS u, greatest(src, dst) AS v FROM g), z AS (SELECT u AS src, v AS dst, c1 - flow AS res FROM w UNION ALL SELECT v, u, c2 + flow FROM w) SELECT src, dst, res FROM z WHERE res > 0"
# One supplier after the other: its parts take from what is left at each, in order, until its own arc is used up.
_EXACT = f"""WITH RECURSIVE {_P2},
  c AS (SELECT p.s, p.part, p.b, f.cap AS own, t.cap AS last FROM p JOIN f ON f.dst = p.s JOIN t ON t.src = p.part WHERE t.cap > 0),
  n AS (SELECT s, row_number() OVER (ORDER BY s) AS k FROM (SELECT DISTINCT s FROM c)),
  d AS MATERIALIZED (SELECT n.k, c.* FROM c JOIN n USING (s)),
  r(k, s, part, amount, room) AS (
    SELECT 0::BIGINT, NULL::BIGINT, part, 0::BIGINT, min(last) FROM d GROUP BY part
    UNION ALL
    SELECT z.k + 1, z.s, z.part, z.x, z.room - z.x FROM (
      SELECT r.k, d.s, r.part, r.room,
             CAST(CASE WHEN d.s IS NULL THEN 0 ELSE greatest(0, least(least(d.b, r.room), d.own - coalesce(sum(least(d.b, r.room)) OVER (PARTITION BY d.s ORDER BY r.part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS BIGINT) AS x
      FROM r LEFT JOIN d ON d.k = r.k + 1 AND d.part = r.part) AS z
    WHERE z.k < (SELECT max(k) FROM n))
SELECT concat('1:', s, ':', part, ':2=', amount) AS path FROM r WHERE amount > 0"""


def oracle_sql() -> dict[str, str]:
    return {
        "edge_build": f"WITH {_E} SELECT u, v, 1::BIGINT AS cap_uv, 1::BIGINT AS cap_vu, 0::BIGINT AS flow FROM e",
        "degree": f"WITH {_A} SELECT src AS v, count(*) AS degree FROM a GROUP BY 1",
        "symmetrised": f"WITH {_A} SELECT src, dst FROM a",
        "bfs_levels": f"{_BFS} SELECT v, d FROM l",
        "bfs_level_histogram": f"{_BFS} SELECT d, count(*) AS n FROM l GROUP BY d",
        "reachable_set": f"WITH RECURSIVE {_GB}, r(v) AS (SELECT 1000001::BIGINT UNION SELECT g.dst FROM r JOIN g ON g.src = r.v WHERE g.cap > 0) SELECT v FROM r",
        "terminal_pick": f"WITH {_A}, d AS (SELECT src AS v FROM a GROUP BY 1 HAVING count(*) > 5 ORDER BY 1 LIMIT 20), n AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM d) SELECT v, CASE WHEN k % 2 = 1 THEN 'source' ELSE 'sink' END AS kind FROM n",
        "capacity_merge": "SELECT 1000000 + l_suppkey AS u, 4000000 + l_partkey AS v, CAST(sum(l_quantity) AS BIGINT) AS cap_uv, 0::BIGINT AS cap_vu, 0::BIGINT AS flow FROM lineitem GROUP BY 1, 2",
        "residual_arcs": _RESIDUAL,
        "arc_log_scan": _RESIDUAL,
        "one_hop_extend": f"WITH {_P2} SELECT v, concat('1:', s, ':', part, '=', b) AS path FROM p",
        "topk_paths": f"WITH {_P2}, k AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY b DESC, s) AS n FROM p) SELECT v, concat('1:', s, ':', part, '=', b) AS path FROM k WHERE n <= 3",
        "random_k_paths": f"WITH {_P2}, k AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY md5(concat('7:1:', s, ':', part)), s) AS n FROM p) SELECT v, concat('1:', s, ':', part, '=', b) AS path FROM k WHERE n <= 2",
        "saturated_filter": f"""WITH {_GB},
  r AS MATERIALIZED (SELECT src, dst, cap - ({_USED}) AS res FROM g WHERE src <> 2 AND dst <> 2),
  x AS MATERIALIZED (SELECT dst AS s, res FROM r WHERE src = 1 AND res > 0),
  y AS MATERIALIZED (SELECT src AS s, dst AS part, res FROM r WHERE src <> 1 AND res > 0)
SELECT y.part AS v, concat('1:', s, ':', y.part, '=', least(x.res, y.res)) AS path FROM x JOIN y USING (s)""",
        "two_hop_meet": f"WITH {_P2} SELECT concat('1:', s, ':', part, ':2=', least(b, t.cap)) AS path FROM p JOIN t ON t.src = part WHERE t.cap > 0",
        "greedy_acceptance": f"WITH {_P2}, o AS (SELECT p.*, f.cap AS c1, q.cap AS c2, coalesce(sum(b) OVER (PARTITION BY s ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN f ON f.dst = s JOIN q ON q.src = s AND q.dst = part), z AS (SELECT s, part, CAST(least(b, c1 - before, c2) AS BIGINT) AS amount FROM o) SELECT concat('1:', s, ':', part, '=', amount) AS path FROM z WHERE amount > 0",
        "exact_acceptance": _EXACT,
        "two_line_meet": f"WITH {_P2}, o AS (SELECT p.*, t.cap AS room, coalesce(sum(b) OVER (PARTITION BY part ORDER BY b DESC, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN t ON t.src = part) SELECT concat('1:', s, ':', part, ':2=', CAST(least(b, room - before) AS BIGINT)) AS path FROM o WHERE room > before",
        "tree_flow_by_joins": f"WITH {_TREE} SELECT true AS upper, CAST(sum(f) AS BIGINT) AS flow_value FROM re UNION ALL SELECT false, CAST(sum(f) AS BIGINT) FROM re",
        "adjacency_scan": f"WITH {_E} SELECT u AS src, v AS dst FROM e",
        "dimacs_scan": "SELECT 1000002 + l_suppkey AS u, 4000002 + l_partkey AS v, CAST(sum(l_quantity) AS BIGINT) AS cap_uv, 0::BIGINT AS cap_vu, 0::BIGINT AS flow FROM lineitem GROUP BY 1, 2",
        "folded_ids": "SELECT c_custkey, CAST(-(c_custkey + 3) AS BIGINT) AS id FROM customer",
        "tree_max_flow": f"WITH {_TREE} SELECT CAST(sum(f) AS BIGINT) AS flow_value FROM re",
        "path_round_tree_flow": f"WITH {_TREE} SELECT CAST(sum(f) AS BIGINT) AS flow_value FROM re",
        "tree_flow_edges": f"WITH {_TREE} SELECT n_regionkey + 10 AS v, CAST(f AS BIGINT) AS flow FROM re",
        # A region or nation is on the source side if every arc above it has capacity left; a customer never is, since
        # nothing limits the arc after it.
        "tree_cut_side": f"""WITH {_TREE}, sr AS (SELECT n_regionkey FROM re WHERE f < 4400 * n),
  sn AS (SELECT n_nationkey FROM na JOIN sr USING (n_regionkey) WHERE n > 0 AND f < 4500 * n)
SELECT 1::BIGINT AS v UNION ALL SELECT n_regionkey + 10 FROM sr UNION ALL SELECT n_nationkey + 100 FROM sn""",
        # Checks of this engine's own results: no row may violate them.
        "flow_conservation": "SELECT 0::BIGINT AS violations",
        "flow_capacity": "SELECT 0::BIGINT AS violations",
        "duality_gap": "SELECT 0::BIGINT AS violations",
    }
