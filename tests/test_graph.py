"""Readers, builders, path functions, flows: against literals, an augmenting-path solver and duality."""

import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import graph as G
from sluice.operators import blocks, build, decompose, maxflow, paths, prefix, traverse, verify
from sluice.operators.maxflow import max_flow
from sluice.plans.config import FlowConfig
from sluice.plans.rounds import network, path_rounds, run, search, solve
from sluice.sources import graph as sources
from sluice.sources import sinks

INF = 10_000_000


def brute_flow(arcs, s=1, t=2):
    """Value and source side of the least cut, one augmenting path after the other."""
    res = defaultdict(lambda: defaultdict(int))
    for u, v, c in arcs:
        if u != v:
            res[u][v] += c
            res[v][u] += 0
    value = 0
    while True:
        before, queue = {s: None}, deque([s])
        while queue and t not in before:
            u = queue.popleft()
            for v, c in res[u].items():
                if c > 0 and v not in before:
                    before[v] = u
                    queue.append(v)
        if t not in before:
            return value, set(before)
        way, v = [], t
        while before[v] is not None:
            way.append((before[v], v))
            v = before[v]
        gain = min(res[u][v] for u, v in way)
        for u, v in way:
            res[u][v] -= gain
            res[v][u] += gain
        value += gain


def both(*pairs):
    return [x for u, v, c in pairs for x in ((u, v, c), (v, u, c))]


TINY = {
    "single edge": ([(1, 3, INF), *both((3, 4, 1)), (4, 2, INF)], 1, {1, 3}),
    "textbook": ([(1, 11, 16), (1, 12, 13), (11, 13, 12), (12, 11, 4), (13, 12, 9), (12, 14, 14), (14, 13, 7), (13, 2, 20), (14, 2, 4)], 23, {1, 11, 12, 14}),
    "unit cycle": ([(1, 3, INF), *both((3, 4, 1), (4, 5, 1), (5, 6, 1), (6, 3, 1)), (5, 2, INF)], 2, {1, 3}),
    "apart": ([(1, 3, INF), *both((3, 4, 1), (5, 6, 1)), (6, 2, INF)], 0, {1, 3, 4}),
    "shared arc": ([(1, 3, 1), *both((3, 4, 1), (4, 5, 1), (5, 3, 1), (4, 2, 1))], 1, {1}),
    "parallel": ([(1, 3, INF), (3, 4, 2), (3, 4, 3), (4, 2, INF)], 5, {1, 3}),
    "pairing": ([(1, 3, 1), (1, 4, 1), (3, 4, 1), (3, 5, 1), (4, 6, 1), (5, 2, 1), (6, 2, 1)], 2, {1}),
    "zero": ([(1, 3, INF), (3, 4, 0), (4, 2, INF)], 0, {1, 3}),
}


def frame(spark, arcs):
    return spark.createDataFrame(arcs, "src bigint, dst bigint, cap bigint")


@pytest.fixture(params=["one task", "joins", "joins in ranges"])
def sweeps(request, monkeypatch):
    """Sweeps of small level graphs by one task; by joins only; and those with every key summed in ranges."""
    if request.param != "one task":
        monkeypatch.setattr(maxflow, "LOCAL_ARCS", 0)
    if request.param == "joins in ranges":
        monkeypatch.setattr(prefix, "WHOLE_KEY", 1)


@pytest.mark.parametrize("name", TINY)
def test_tiny_graphs(spark, name, monkeypatch):
    monkeypatch.setattr(maxflow, "LOCAL_ARCS", 0 if len(name) % 2 else maxflow.LOCAL_ARCS)
    arcs, value, side = TINY[name]
    result = max_flow(build.merge_parallel(frame(spark, arcs)))
    assert (result.value, result.cut_value, result.converged) == (value, value, True)
    assert {r["v"] for r in result.cut_side.collect()} == side


def test_random_graph_value_cut_checks_and_paths(spark, sweeps):
    rng = random.Random(1)
    vertices = [1, 2, *range(10, 18)]
    arcs = [(1, 10, 9), (1, 11, 5), (16, 2, 6), (17, 2, 7), *((*rng.sample(vertices, 2), rng.randint(0, 6)) for _ in range(18))]
    result = max_flow(build.merge_parallel(frame(spark, arcs)))
    value, side = brute_flow(arcs)
    assert value
    assert (result.value, result.cut_value) == (value, value)
    assert {r["v"] for r in result.cut_side.collect()} == side
    assert verify.capacity_violations(result.edges).count() == 0
    assert verify.conservation_violations(result.edges).count() == 0
    found = decompose.decompose(result.edges).collect()
    assert sum(r["amount"] for r in found) == value
    assert all(r["path"][0]["u"] == 1 and r["path"][-1]["v"] == 2 for r in found)
    stopped = max_flow(build.merge_parallel(frame(spark, arcs)), max_rounds=0)
    assert not stopped.converged and stopped.cut_value is None
    assert run(result.edges, FlowConfig()).sweeps == 0


@pytest.mark.parametrize("settings", [{"kept_paths": 2}, {"kept_paths": None}, {"path_choice": "random", "kept_paths": 3, "forward": "one"}, {"bidirectional": False, "longest_path": 4}])
def test_path_rounds_then_sweeps(spark, settings):
    arcs = TINY["pairing"][0]
    edges, metrics = path_rounds(build.merge_parallel(frame(spark, arcs)), FlowConfig(**settings), rounds=4)
    assert verify.capacity_violations(edges).count() == 0 and verify.conservation_violations(edges).count() == 0
    assert maxflow.flow_value(edges) > 0
    assert max_flow(edges).value == 2 and metrics


@pytest.mark.parametrize(("kept", "want"), [(100, 100), (None, 140), (512, 140)])
def test_any_number_of_paths_is_kept(spark, kept, want):
    """140 paths meet in one vertex: the setting alone says how many of them stay."""
    middle = range(100, 240)
    arcs = [(1, 3, 500), *((3, m, 1) for m in middle), *((m, 4, 1) for m in middle), (4, 5, 500), (5, 6, 500), (6, 2, 500)]
    _, metrics = path_rounds(build.merge_parallel(frame(spark, arcs)), FlowConfig(kept_paths=kept, bidirectional=False), rounds=3)
    assert max(n for _, name, n in metrics if name == "source_paths") == want + 142
    assert sum(n for _, name, n in metrics if name == "source_truncated") == 140 - want


def test_neighbours_offer_again_to_a_vertex_that_lost_its_paths(spark):
    """3-4 is used up by the first way; what 4 lost is offered to it again over 5."""
    arcs = [(1, 3, 2), (3, 4, 1), (4, 2, 2), (3, 5, 1), (5, 6, 1), (6, 4, 1)]
    edges, metrics = path_rounds(build.merge_parallel(frame(spark, arcs)), FlowConfig(kept_paths=1), rounds=8)
    assert maxflow.flow_value(edges) == 2
    assert any(name == "source_notified" for _, name, _ in metrics)


def test_path_rounds_compare_only_what_may_have_been_sent(spark, monkeypatch):
    """The longest offers of a turn are new; no path stands twice where paths are chosen; unmeasured turns give the same flow."""
    from sluice.plans import rounds

    rng, compared, twice = random.Random(4), [], []
    arcs = [(u, v, rng.randint(1, 3)) for u in range(1, 14) for v in range(1, 14) if u != v and rng.random() < 0.3]
    edges = build.merge_parallel(frame(spark, arcs))
    known, best = rounds.not_forwarded, rounds.best_paths
    longest = lambda df: df.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    with monkeypatch.context() as m:
        m.setattr(rounds, "not_forwarded", lambda offers, sent: compared.append((longest(offers), longest(sent))) or known(offers, sent))
        m.setattr(rounds, "best_paths", lambda rows, k: twice.append(rows.count() - rows.distinct().count()) or best(rows, k))
        flow, _ = path_rounds(edges, FlowConfig(kept_paths=3), rounds=4)
    assert compared and all(a <= b for a, b in compared) and not any(twice)
    again, _ = path_rounds(edges, FlowConfig(kept_paths=3), rounds=4, measured=False)
    assert sorted(map(tuple, flow.collect())) == sorted(map(tuple, again.collect()))


class Lost(Exception):
    pass


@pytest.mark.parametrize(("kind", "after"), [("paths", 2), ("sweeps", 1)])
def test_a_run_goes_on_from_its_last_whole_round(spark, tmp_path, kind, after):
    """Broken off after a commit, with a later round half written: the rest gives what an unbroken run gives."""
    from sluice.plans.journal import Journal

    rng = random.Random(12)
    arcs = [(1, v, rng.randint(1, 9)) for v in range(10, 15)] + [(v, 2, rng.randint(1, 9)) for v in range(20, 25)]
    arcs += [(u, v, rng.randint(1, 5)) for u in range(10, 15) for v in range(20, 25) if rng.random() < 0.6] + [(10, 11, 3), (21, 20, 4), (24, 10, 2)]
    edges, config = build.merge_parallel(frame(spark, arcs)), FlowConfig(kept_paths=2, path_rounds=4)
    method = "paths" if kind == "paths" else "sweep"
    told = []
    whole = run(edges, config, method, Journal(spark, None, report=lambda *a: told.append(a)))
    assert {k for k, *_ in told} >= {kind} and all(seconds >= 0 for *_, seconds in told) and any("flow_value" in f for _, _, f, _ in told)

    def lose(name, turn, figures, seconds):
        if name == kind and len(told) == after:
            raise Lost
        told.append(name)

    told, path = [], f"file://{tmp_path}/journal"
    with pytest.raises(Lost):
        run(edges, config, method, Journal(spark, path, report=lose))
    committed = Journal(spark, path).last()
    assert committed["kind"] == kind
    edges.limit(1).write.parquet(f"{path}/commit-000099/edges")  # no manifest: this round never was
    again = run(edges.limit(0), config, method, Journal(spark, path))
    assert (again.value, again.cut_value, again.converged) == (whole.value, whole.cut_value, True) == (brute_flow(arcs)[0],) * 2 + (True,)
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, whole.edges.collect()))
    if kind == "sweeps":
        assert again.metrics == whole.metrics
    kept = [p.name for p in (tmp_path / "journal").iterdir() if (p / "manifest").exists()]
    assert len(kept) == 1  # earlier rounds went with the later commits
    Journal(spark, path).clear()
    assert Journal(spark, path).last() is None


def test_dimacs_sizes_are_compared(spark):
    from sluice.sources.graph import dimacs_figures

    lines = spark.createDataFrame([("c x",), ("p max 4 3",), ("n 1 s",), ("n 4 t",), ("a 1 2 5",), ("a 2 2 1",), ("a 2 4 3",)], "value string")
    assert {r["name"]: r["value"] for r in dimacs_figures(lines, "FAILFAST").collect()} == {"problem_lines": 1, "vertices_stated": 4, "arcs_stated": 3, "arcs": 3, "vertex_largest": 4}
    more = lines.unionByName(spark.createDataFrame([("a 3 9 1",)], "value string"))
    assert {r["name"]: r["value"] for r in dimacs_figures(more).collect()}["vertex_largest"] == 9
    with pytest.raises(Exception, match="states 4 vertices and 3 arcs"):
        dimacs_figures(more, "FAILFAST").collect()


def test_solve_with_terminals(spark):
    arcs = frame(spark, [(3, 4, 1), (4, 5, 1), (3, 5, 1), (5, 6, 1)])
    assert solve(arcs, FlowConfig(sources=(3,), sinks=(5,))).value == 2
    assert solve(arcs, FlowConfig(sources=(3,), sinks=(5,)), method="paths").value == 2
    assert solve(arcs, FlowConfig(sources=(3,), sinks=(5,), undirected=False)).value == 2
    with pytest.raises(Exception, match="both source and sink"):
        network(arcs, FlowConfig(sources=(3,), sinks=(3,))).collect()
    picked = build.pick_terminals(build.symmetrise(arcs), 1, 1, seed=3).collect()
    assert {r["kind"] for r in picked} == {"source", "sink"} and len({r["v"] for r in picked}) == 2


def test_random_terminals(spark):
    """Picked by degree, disjoint, the same in every run with a seed; the flow between them is that of their network."""
    pairs = [(a, b, 1) for a in range(10, 16) for b in range(10, 16) if a < b]
    config = FlowConfig(random_terminals=2, terminal_degree=3, seed=5, max_random_capacity=4)
    edges = network(frame(spark, pairs), config)
    rows = [tuple(r)[:4] for r in edges.collect()]
    assert rows and sorted(rows) == sorted(tuple(r)[:4] for r in network(frame(spark, pairs), config).collect())
    ends = [r for r in rows if r[0] in (1, 2)]
    assert sorted(r[0] for r in ends) == [1, 1, 2, 2] and len({r[1] for r in ends}) == 4
    inner = {r[2] for r in rows if r[0] not in (1, 2)}
    assert inner <= {1, 2, 3, 4} and len(inner) > 1 and all(r[2] == r[3] for r in rows if r[0] not in (1, 2))
    arcs = [x for u, v, c, d in rows for x in ((u, v, c), (v, u, d))]
    assert solve(frame(spark, pairs), config).value == brute_flow(arcs)[0]


def layered(seed):
    rng = random.Random(seed)
    layers = [[1], list(range(10, 16)), list(range(20, 26)), [2]]
    return layers, [(k, u, v, rng.randint(1, 9)) for k in range(3) for u in layers[k] for v in layers[k + 1] if k != 1 or rng.random() < 0.6]


def test_sweeps_in_memory_agree_with_joins(spark):
    """The same flow on every arc and the same gain of every sweep, also where a limit ends them."""
    import numpy as np

    from sluice.plans.scratch import Scratch

    several = 0
    for seed in (4, 5):
        layers, arcs = layered(seed)
        graph = spark.createDataFrame(arcs, "level int, src bigint, dst bigint, res bigint")
        columns = [np.array(c) for c in zip(*arcs)]
        flow, gains = maxflow.block_in_memory(*columns)
        several += len(gains) > 1
        assert (flow >= 0).all() and (flow <= columns[3]).all()
        for v in layers[1] + layers[2]:
            assert flow[columns[2] == v].sum() == flow[columns[1] == v].sum()
        assert sum(gains) == flow[columns[0] == 0].sum() <= brute_flow([a[1:] for a in arcs])[0]
        for limit in (None, maxflow.Limit(sweeps=1), maxflow.Limit(approx=0.5)):
            found = [maxflow.level_flow(graph, len(arcs), 3, 10, Scratch(spark, "t"), "f", limit=limit, local_arcs=n) for n in (None, 0)]
            (one, used, got), (joined, also_used, also_got) = found
            assert got == also_got and used == also_used == one.count()
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, joined.select(one.columns).collect()))
            assert limit is not None or got == gains
    assert several
    assert maxflow.block_in_memory(*(c[:0] for c in columns))[1] == []


def test_sweeps_by_joins_end_in_one_task(spark, monkeypatch):
    """Arcs that the source no longer reaches go between sweeps, and what is small then needs no more joins; the flow is the same."""
    from sluice.plans.scratch import Scratch

    rng = random.Random(238)
    arcs = [(0, 1, 100 + k, rng.randint(1, 9)) for k in range(6)] + [(1, 100 + i, 200 + j, rng.randint(1, 4)) for i in range(6) for j in range(8) if rng.random() < 0.6]
    arcs += [(2, 200 + j, 300 + k, rng.randint(1, 3)) for j in range(8) for k in range(6) if rng.random() < 0.5] + [(3, 300 + k, 2, rng.randint(1, 5)) for k in range(6)]
    graph = spark.createDataFrame(arcs, "level int, src bigint, dst bigint, res bigint")
    swept, sweep = [], maxflow.sweep
    monkeypatch.setattr(maxflow, "sweep", lambda graph, *more: swept[-1].append(graph.count()) or sweep(graph, *more))
    results = []
    for local in (0, len(arcs) - 1, len(arcs)):
        swept.append([])
        flow, _, gains = maxflow.level_flow(graph, len(arcs), 4, 10, Scratch(spark, "f"), f"local-{local}", local_arcs=local)
        results.append((sorted(map(tuple, flow.collect())), gains))
    assert results[0] == results[1] == results[2] and len(results[0][1]) > 2
    by_joins, one, none = swept
    assert by_joins[0] == len(arcs) and len(by_joins) - len(results[0][1]) in (0, 1) and by_joins == sorted(set(by_joins), reverse=True)
    assert one == [len(arcs)] and none == []


def test_a_hub_sends_no_other_level_through_ranges(spark, monkeypatch):
    """Only the levels at which a hub stands are summed in ranges, and what the sink gathers is summed nowhere; arcs left to a level graph stay in buckets."""
    from sluice.plans.scratch import Scratch

    arcs = [(1, 10 + i, 5) for i in range(4)] + [(10 + i, 20 + j, 2) for j in range(12) for i in (j % 4, (j + 1) % 4) if j % 3 or i % 2] + [(20 + j, 2, 2) for j in range(12)]
    monkeypatch.setattr(prefix, "WHOLE_KEY", 10)
    widest = []
    for module in (maxflow, decompose):
        monkeypatch.setattr(module, "prefix_sums", lambda df, key, order, value, most, *more, **named: widest.append(most) or prefix.prefix_sums(df, key, order, value, most, *more, **named))
    result = max_flow(build.merge_parallel(frame(spark, arcs)), local_arcs=0)
    assert (result.value, result.cut_value) == (brute_flow(arcs)[0],) * 2
    assert decompose.decompose(result.edges).agg(F.sum("amount")).first()[0] == result.value
    assert widest and max(widest) <= prefix.WHOLE_KEY
    graph = spark.createDataFrame([(0, 10 + i % 3, 20 + i % 7, 1 + i) for i in range(21)], "level int, src bigint, dst bigint, res bigint")
    held, size = maxflow.reached_arcs(graph, 1, Scratch(spark, "reached"), "r")
    assert size == 21 and "Exchange" not in held.groupBy("dst").count()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limits", [{}, {"max_rounds": 1}, {"approx": 0.3}])
def test_a_run_means_the_same_at_every_size(spark, limits):
    rng = random.Random(11)
    arcs = [(1, v, rng.randint(1, 9)) for v in range(10, 16)] + [(v, 2, rng.randint(1, 9)) for v in range(20, 26)]
    arcs += [(u, v, rng.randint(1, 5)) for u in range(10, 16) for v in range(20, 26) if rng.random() < 0.5] + [(10, 11, 3), (21, 20, 4)]
    runs = [max_flow(build.merge_parallel(frame(spark, arcs)), local_arcs=n, **limits) for n in (None, 0)]
    assert runs[0].metrics == runs[1].metrics and runs[0].sweeps == runs[1].sweeps and runs[0].value == runs[1].value
    assert sorted(map(tuple, runs[0].edges.collect())) == sorted(map(tuple, runs[1].edges.collect()))
    if not limits:
        assert runs[0].converged and runs[0].value == brute_flow(arcs)[0] and runs[0].sweeps > 1
    else:
        assert runs[0].sweeps == 1 or "approx" in limits


@pytest.mark.parametrize("merged", [False, True])
def test_arc_log(spark, monkeypatch, merged):
    """Residuals after changes as a dictionary has them; no exchange of what the log holds, also when it is merged."""
    from sluice.plans import arcs as A
    from sluice.plans.scratch import Scratch

    monkeypatch.setattr(A, "LOG_SHARE", 0 if merged else 100)
    rng = random.Random(2)
    held = {(u, v): rng.randint(1, 9) for u in range(20) for v in range(20) if u != v and rng.random() < 0.3}
    log = A.ArcLog(Scratch(spark, "log"), "arcs", spark.createDataFrame([(*k, r) for k, r in held.items()], "src bigint, dst bigint, res bigint"))
    for _ in range(3):
        flow = {k: rng.randint(1, r) for k, r in held.items() if r > 0 and rng.random() < 0.4 and k[0] < k[1]}
        for (u, v), f in flow.items():
            held[u, v] -= f
            held[v, u] = held.get((v, u), 0) + f
        log.change(spark.createDataFrame([(*k, f) for k, f in flow.items()], "src bigint, dst bigint, flow bigint"), len(flow))
    assert {(r["src"], r["dst"]): r["res"] for r in log.rows().collect()} == {k: r for k, r in held.items() if r}
    near = spark.createDataFrame([(3, "x"), (4, "y"), (99, "z")], "src bigint, tag string")
    assert {(r["src"], r["dst"]): (r["res"], r["tag"]) for r in log.rows(near).collect()} == {k: (r, "xy"[k[0] - 3]) for k, r in held.items() if r and k[0] in (3, 4)}
    plan = log.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and log.generation == (3 if merged else 0)
    log.close()


def serial(candidates, left):
    """Amounts of paths taken one after the other, shorter first."""
    left, out = dict(left), {}
    for path, most in sorted(candidates.items(), key=lambda x: (len(x[0]), x[0])):
        amount = min([most] + [left.get(hop, 0) for hop in path])
        if amount > 0:
            out[path] = amount
            for hop in path:
                left[hop] -= amount
    return out


def as_paths(spark, rows):
    return spark.createDataFrame([([{"u": u, "v": v} for u, v in p], b) for p, b in rows], f"path {G.PATH}, bottleneck bigint")


@pytest.mark.parametrize("local", [0, 30, 1 << 20])
@pytest.mark.parametrize("ranges", [False, True])
def test_acceptance_is_greedy_one_after_the_other(spark, monkeypatch, local, ranges):
    monkeypatch.setattr(paths, "LOCAL_HOPS", local)
    if ranges:
        monkeypatch.setattr(prefix, "WHOLE_KEY", 3)
    rng = random.Random(local + ranges)
    left = {(u, u + 10 * k + v): rng.randint(0, 5) for u in range(4) for v in range(3) for k in range(3)}
    candidates = {tuple(rng.sample(list(left), rng.randint(1, 4))): rng.randint(1, 4) for _ in range(60)}
    # What is turned down charges nothing: the third way is free where the second one fails.
    chain = {((100, 101),): 1, ((100, 101), (102, 103)): 1, ((102, 103), (104, 105), (106, 107)): 1}
    candidates, left = candidates | chain, left | {(100, 101): 1, (102, 103): 1, (104, 105): 1, (106, 107): 1}
    arcs = spark.createDataFrame([(*k, r) for k, r in left.items() if r], "src bigint, dst bigint, res bigint")
    got = {tuple((h["u"], h["v"]) for h in r["path"]): r["amount"] for r in paths.accept(as_paths(spark, candidates.items()), arcs).collect()}
    assert got == serial(candidates, left) and len([p for p in chain if p in got]) == 2
    assert paths.accept(as_paths(spark, []), arcs).count() == 0


def test_a_chain_of_candidates_takes_a_turn_for_each_range_at_most(spark, monkeypatch):
    """Each way waits for the one before: one turn after the other for every way, before ranges were gone through in order."""
    from sluice.plans.scratch import Scratch

    monkeypatch.setattr(paths, "LOCAL_HOPS", 20)
    labels, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, label, *more: labels.append(label) or table(self, df, label, *more))
    candidates = {((k, k + 1), (k + 1, k + 2)): 1 for k in range(10, 50)}
    left = {(k, k + 1): 1 for k in range(10, 51)}
    arcs = spark.createDataFrame([(*k, r) for k, r in left.items()], "src bigint, dst bigint, res bigint")
    got = {tuple((h["u"], h["v"]) for h in r["path"]): r["amount"] for r in paths.accept(as_paths(spark, candidates.items()), arcs).collect()}
    assert got == serial(candidates, left) and len(got) == 20
    assert 1 < len([x for x in labels if "/turn-" in x]) <= 5


@pytest.mark.parametrize("ranges", [False, True])
def test_paths_meet_along_two_lines(spark, monkeypatch, ranges):
    from sluice.plans.scratch import Scratch

    if ranges:
        monkeypatch.setattr(prefix, "WHOLE_KEY", 2)
    rng = random.Random(8)
    rows = {"s": [], "t": []}
    for v in range(100, 106):
        for k in range(rng.randint(1, 5) if v < 105 else 0):
            rows["s"].append((v, [{"u": 1, "v": 10 + k}, {"u": 10 + k, "v": v}], rng.randint(1, 6)))
        for k in range(rng.randint(1, 5)):
            rows["t"].append((v, [{"u": v, "v": 200 + k}, {"u": 200 + k, "v": 2}], rng.randint(1, 6)))
    sides = [spark.createDataFrame(r, f"v bigint, path {G.PATH}, bottleneck bigint") for r in rows.values()]
    want = {}
    for v in range(100, 106):
        s, t = ([[list(map(lambda h: (h["u"], h["v"]), p)), b] for w, p, b in sorted(rows[k], key=lambda x: (-x[2], [(h["u"], h["v"]) for h in x[1]])) if w == v] for k in "st")
        while s and t:
            amount = min(s[0][1], t[0][1])
            want[tuple(s[0][0] + t[0][0])] = amount
            for line in (s, t):
                line[0][1] -= amount
                if not line[0][1]:
                    line.pop(0)
    got = {tuple((h["u"], h["v"]) for h in r["path"]): r["bottleneck"] for r in paths.meet_along_lines(*sides, Scratch(spark, "m")).collect()}
    assert got == want and len(got) < len(rows["s"]) + len(rows["t"])
    ends = paths.meet_along_lines(paths.seed_paths(spark, 1), spark.createDataFrame([(1, [{"u": 1, "v": 2}], 3), (1, [{"u": 1, "v": 5}, {"u": 5, "v": 2}], 4)], f"v bigint, path {G.PATH}, bottleneck bigint"), Scratch(spark, "m"))
    assert sorted(r["bottleneck"] for r in ends.collect()) == [3, 4]


@pytest.mark.parametrize("ranges", [False, True])
def test_lines_of_few_stretches_meet_like_merged_ones(spark, monkeypatch, ranges):
    """Short lines are compared in place, long ones merged: the same ways; and S paths are made once."""
    from sluice.plans.scratch import Scratch

    plans, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, *a, **k: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), table(self, df, *a, **k))[1])
    if ranges:
        monkeypatch.setattr(prefix, "WHOLE_KEY", 2)
    s = spark.range(60).select((F.col("id") % 7).alias("v"), F.expr("array(named_struct('u', 100 + id, 'v', id % 7))").alias("path"), (F.col("id") % 5 + 1).alias("bottleneck"))
    t = spark.range(20, 50, 2).select((F.col("id") % 6).alias("v"), F.expr("array(named_struct('u', id % 6, 'v', 200 + id), named_struct('u', 200 + id, 'v', 2L))").alias("path"), (F.col("id") % 4 + 2).alias("bottleneck"))
    few = sorted(map(str, paths.meet_along_lines(s, t, Scratch(spark, "m")).collect()))
    assert sum("Range (0, 60" in p for p in plans) == 1 and max(p.count("Range (0, 60") for p in plans) == 1
    monkeypatch.setattr(paths, "FEW_STRETCHES", 0)
    assert few == sorted(map(str, paths.meet_along_lines(s, t, Scratch(spark, "m")).collect())) and len(few) > 15


def test_a_draw_from_lists_is_that_of_all_offers(spark):
    """Where a vertex's paths are few, one is drawn for each arc without an exchange of the arcs."""
    rng = random.Random(5)
    rows = [(v, [{"u": 1, "v": rng.choice((30, 31, 50 + k))}, {"u": 50 + k, "v": v}], rng.randint(1, 9)) for v in range(10, 18) for k in range(v % 5)]
    some = spark.createDataFrame(rows, f"v bigint, path {G.PATH}, bottleneck bigint")
    for backward in (False, True):
        ends = [(a, b) for a in range(10, 18) for b in range(30, 36)]
        arcs = spark.createDataFrame([((b, a) if backward else (a, b)) + (rng.randint(0, 9),) for a, b in ends], "src bigint, dst bigint, res bigint")
        key = lambda df: sorted(map(str, df.collect()))
        drawn = paths.extend(some, arcs, backward, draw=4, most=4)
        assert key(drawn) == key(paths.extend(some, arcs, backward, draw=4)) and drawn.count() > 20
        assert "Window" not in drawn._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [0, 1 << 21])
def test_only_arcs_asked_for_are_added_up(spark, monkeypatch, held):
    """A log tells the residuals of some arcs as its whole would, and leaves its buckets where they are."""
    from sluice.plans import arcs as A
    from sluice.plans.scratch import Scratch

    monkeypatch.setattr(A, "ASKED_ARCS", held)
    scratch = Scratch(spark, "asked")
    rows = [(u, 100 + v, 1 + (u + v) % 5) for u in range(10) for v in range(10)]
    log = A.ArcLog(scratch, "arcs", spark.createDataFrame(rows, "src bigint, dst bigint, res bigint"))
    used = spark.createDataFrame([(u, 100 + v, 1) for u, v, _ in ((u, v, 0) for u in range(10) for v in range(0, 10, 3))], "src bigint, dst bigint, flow bigint")
    log.change(used, 4)
    asked = spark.createDataFrame([(u, 100 + v, u) for u in range(0, 12, 2) for v in range(5)], "src bigint, dst bigint, tag bigint")
    whole = {(r["src"], r["dst"]): r["res"] for r in log.rows().collect()}
    with scratch.in_buckets():
        got = log.among(asked, 30)
        assert {(r["src"], r["dst"]): (r["res"], r["tag"]) for r in got.collect()} == {(u, 100 + v): (whole.get((u, 100 + v), 0), u) for u in range(0, 12, 2) for v in range(5)}
        assert ("ShuffledHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == bool(held)
        want = paths.bottlenecks(some := spark.createDataFrame([(103, [{"u": 2, "v": 103}], 9), (100, [{"u": 4, "v": 100}], 9), (77, [{"u": 4, "v": 77}], 9)], f"v bigint, path {G.PATH}, bottleneck bigint"), log.rows())
        assert sorted(map(str, paths.bottlenecks(some, log, 3).collect())) == sorted(map(str, want.collect()))
    log.close()


@pytest.mark.parametrize("backward", [False, True])
def test_promising_arcs_hold_the_best_offers(spark, backward):
    """Offers over them give each vertex as good a list as offers over all arcs."""
    from sluice.plans.scratch import Scratch

    rng = random.Random(3)
    near, far = range(10, 18), range(30, 34)
    turn = lambda hops: [{"u": b, "v": a} for a, b in hops[::-1]] if backward else [{"u": a, "v": b} for a, b in hops]
    rows = [(v, turn([(1, rng.choice(far)), (40 + k, v)] if rng.random() < 0.5 else [(1, v)]), rng.randint(1, 9)) for v in near for k in range(rng.randint(1, 4))]
    some = spark.createDataFrame(rows, f"v bigint, path {G.PATH}, bottleneck bigint").dropDuplicates(["v", "path"])
    ends = [(a, b) for a in near for b in far if rng.random() < 0.8]
    arcs = spark.createDataFrame([((b, a) if backward else (a, b)) + (rng.randint(0, 9),) for a, b in ends], "src bigint, dst bigint, res bigint")
    for k in (1, 3):
        chosen, n = paths.promising_arcs(some, arcs, k, Scratch(spark, "p"), "p", backward, newest=1)
        every = paths.extend(some, arcs, backward)
        assert n == paths.extend(some.where(F.size("path") == 1), arcs, backward).count()
        key = lambda df: sorted((r["v"], -r["bottleneck"], len(r["path"])) for r in paths.best_paths(df, k).collect())
        assert key(paths.extend(some, chosen, backward)) == key(every)
        assert max(r["n"] for r in chosen.groupBy("src" if backward else "dst").agg(F.count("*").alias("n")).collect()) <= k


def test_arcs_in_buckets_stay_in_place(spark):
    from sluice.plans.scratch import Scratch

    arcs = Scratch(spark, "t").bucketed(spark.range(1000).selectExpr("id % 50 AS src", "id AS dst"), "arcs", "src", distinct=True)
    other = spark.range(50).selectExpr("id AS src", "id * 2 AS x")
    plan = arcs.hint("merge").join(other.hint("merge"), "src")._jdf.queryExecution().executedPlan().toString()
    assert arcs.count() == 1000 and plan.count("Exchange hashpartitioning") == 1


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from sluice.plans.scratch import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_empty_graph(spark):
    empty = frame(spark, [(3, 3, 1)])
    assert max_flow(build.merge_parallel(empty)).value == 0
    levels, sizes = search(empty, spark.createDataFrame([(3,)], "v bigint"))
    assert sorted(map(tuple, levels.collect())) == [(1, 0), (3, 1)] and sizes == [1, 1]


def test_levels(spark):
    arcs = frame(spark, [(3, 4, 1), (4, 5, 1), (6, 7, 1)])
    levels, _ = search(arcs, spark.createDataFrame([(3,)], "v bigint"))
    assert dict(map(tuple, levels.collect())) == {1: 0, 3: 1, 4: 2, 5: 3}
    assert {r["value"] for r in sinks.level_lines(levels).collect()} == {"1\t0", "3\t1", "4\t2", "5\t3"}
    assert dict(map(tuple, traverse.level_histogram(levels).collect())) == {0: 1, 1: 1, 2: 1, 3: 1}


def test_adjacency_text(spark, tmp_path):
    lines = ["10\tx\t11\t12\tbad\t10\t11", "100000000000007\tx\t11", "13\tx", ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = sorted(map(tuple, sources.parse_adjacency(df).collect()))
    assert got == [(-7, 11), (10, 11), (10, 11), (10, 12)]
    odd = spark.createDataFrame([("20\tx\t1\t20\t99999999999\t21",)], "value string")
    figures = {r["name"]: r["value"] for r in sources.adjacency_figures(df.unionByName(odd)).collect()}
    assert figures == {"lines": 4, "isolated": 1, "neighbours": 10, "malformed": 1, "reserved": 1, "out_of_range": 1, "self_loops": 2, "listed_twice": 1}
    assert {(r["u"], r["v"]) for r in build.unit_edges(sources.parse_adjacency(df)).collect()} == {(-7, 11), (10, 11), (10, 12)}
    for bad in ("2\tx\t11", "10\tx\tbad", "10\tx\t11\t11", "99999999999\tx\t11"):
        with pytest.raises(Exception):  # noqa: B017
            sources.parse_adjacency(spark.createDataFrame([(bad,)], "value string"), "FAILFAST").collect()
    import gzip

    with gzip.open(tmp_path / "g.gz", "wt") as f:
        f.write("10\tx\t11\n")
    assert [tuple(r) for r in sources.read_adjacency(spark, str(tmp_path / "g.gz")).collect()] == [(10, 11)]


def test_dimacs(spark):
    text = "c note\np max 4 3\nn 1 s\nn 4 t\na 1 2 5\na 1 2 2\na 2 4 4\na 3 3 9".split("\n")
    arcs, terminals, problem = sources.parse_dimacs(spark.createDataFrame([(x,) for x in text], "value string"))
    assert sorted(map(tuple, build.merge_parallel(arcs).collect())) == [(3, 4, 7, 0, 0), (4, 6, 4, 0, 0)]
    assert sorted(map(tuple, terminals.collect())) == [(3, "source"), (6, "sink")]
    assert [tuple(r) for r in problem.collect()] == [("max", 4, 3)]
    assert max_flow(build.attach_terminals(build.merge_parallel(arcs), terminals)).value == 4
    with pytest.raises(Exception, match="neither source nor sink"):
        sources.parse_dimacs(spark.createDataFrame([("n 3 x",)], "value string"))[1].collect()
    rows = spark.createDataFrame([(3, 4, 5), (None, 4, 1)], "a bigint, b bigint, c bigint")
    assert [tuple(r) for r in sources.from_table(rows, "a", "b", "c").collect()] == [(3, 4, 5)]
    with pytest.raises(Exception, match="not a vertex id"):
        sources.from_table(spark.createDataFrame([(2, 4)], "a bigint, b bigint"), "a", "b").collect()


def test_path_functions(spark):
    hops = lambda *v: [{"u": a, "v": b} for a, b in zip(v, v[1:])]
    schema = f"a {G.PATH}, b {G.PATH}"
    row = spark.createDataFrame([(hops(1, 2, 3, 4), hops(4, 2, 5)), ([], [])], schema).select(
        *(f(F.col("a")).alias(n) for n, f in (("start", G.start_of), ("end", G.end_of), ("size", G.length_of), ("first", G.drop_first), ("last", G.drop_last), ("all", G.vertices_of))),
        G.join_paths(F.col("a"), F.col("b")).alias("joined"), G.path_text(F.col("a"), F.lit(7)).alias("text"),
    ).collect()
    plain = lambda p: [(h["u"], h["v"]) for h in p]
    assert (row[0]["start"], row[0]["end"], row[0]["size"], row[0]["all"], row[0]["text"]) == (1, 4, 3, [1, 2, 3, 4], "1:2:3:4=7")
    assert plain(row[0]["first"]) == [(2, 3), (3, 4)] and plain(row[0]["last"]) == [(1, 2), (2, 3)]
    assert plain(row[0]["joined"]) == [(1, 2), (2, 5)]
    assert (row[1]["start"], row[1]["size"], row[1]["joined"]) == (None, 0, [])


def test_path_operators(spark):
    arcs = spark.createDataFrame([(1, 3, 5), (3, 4, 2), (4, 2, 1), (4, 3, 2), (3, 5, 0)], "src bigint, dst bigint, res bigint")
    one = paths.extend(paths.seed_paths(spark, 1), arcs)
    two = paths.extend(one, arcs)
    assert [(r["v"], r["bottleneck"]) for r in two.collect()] == [(4, 2)]
    assert paths.extend(two, arcs).select("v").collect()[0]["v"] == 2  # not back to 3
    back = paths.extend(paths.seed_paths(spark, 2), arcs, backward=True)
    whole = paths.meet(two, back)
    taken = paths.accept(whole, arcs).collect()
    assert [r["amount"] for r in taken] == [1]
    assert sorted(map(tuple, paths.as_delta(paths.accept(whole, arcs)).collect())) == [(1, 3, 1), (3, 4, 1), (4, 2, 1)]
    assert paths.bottlenecks(two, arcs.where("dst <> 4")).count() == 0
    assert paths.not_forwarded(two.select("path", "v"), two.select("path", "v")).count() == 0
    assert paths.best_paths(two.unionByName(one), 1).count() == 2
    assert paths.random_paths(two, 1).count() == 1
    pair = one.unionByName(one.selectExpr("v", "array(named_struct('u', 1L, 'v', 7L), named_struct('u', 7L, 'v', 3L)) AS path", "1L AS bottleneck"))
    assert paths.extend(pair, arcs).where("v = 4").count() == 2 and paths.extend(pair, arcs, draw=3).where("v = 4").count() == 1
    assert paths.extend(two, arcs, longest=2).count() == 0 and paths.best_paths(pair, None).count() == 2
    lost = paths.lost_vertices(one, two)
    assert {r["v"] for r in lost.collect()} == {3} and {r["v"] for r in paths.neighbours_of(arcs, lost).collect()} == {1, 4}
    assert paths.accept(spark.createDataFrame([([{"u": 1, "v": 3}], 4), ([{"u": 1, "v": 3}, {"u": 3, "v": 4}], 3)], f"path {G.PATH}, bottleneck bigint"), arcs).orderBy("amount").select("amount").collect() == [(1,), (4,)]


def test_meet_takes_more_tasks_for_more_paths(spark, monkeypatch):
    """A task joins and groups so many paths, whatever the session's number of partitions."""
    s = spark.range(40).select((F.col("id") % 5).alias("v"), F.expr("array(named_struct('u', 100 + id, 'v', id % 5))").alias("path"), (F.col("id") + 1).alias("bottleneck"))
    t = spark.range(5).select(F.col("id").alias("v"), F.expr("array(named_struct('u', id, 'v', 2L))").alias("path"), F.lit(7).cast("bigint").alias("bottleneck"))
    few = paths.meet(s, t)
    monkeypatch.setattr(paths, "TASK_PATHS", 3)
    many = paths.meet(s, t)
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 15
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect())) and many.count() == 40


@pytest.mark.parametrize("whole", [10, 10_000])
def test_prefix_sums(spark, monkeypatch, whole):
    """In the order asked for, whether keys are summed whole or in ranges."""
    from sluice.plans.scratch import Scratch

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") < 600, 7).otherwise(F.col("id") % 5).alias("o"), F.col("id").alias("p"), (F.col("id") % 7).alias("x"))
    monkeypatch.setattr(prefix, "WHOLE_KEY", whole)
    rows = prefix.prefix_sums(df, ["k"], ["o", "p"], "x", 400, Scratch(spark, "t"), "p").collect()
    for k in range(3):
        total = 0
        for r in sorted((r for r in rows if r["k"] == k), key=lambda r: (r["o"], r["p"])):
            assert r["before"] == total
            total += r["x"]


@pytest.mark.parametrize("whole", [10, 10_000])
def test_carried(spark, monkeypatch, whole):
    """The last value so far and the next place, whether keys are taken whole or in ranges."""
    from sluice.plans.scratch import Scratch

    data = [(0, i, i if i % 50 == 49 else None, None) for i in range(0, 600, 3)] + [(1, i, None, [i] if i in (2, 7, 300) else None) for i in range(400)] + [(2, 5, 1, [1])]
    monkeypatch.setattr(prefix, "WHOLE_KEY", whole)
    df = spark.createDataFrame(data, "k int, at bigint, x int, y array<int>").repartition(5)
    got = sorted(map(tuple, prefix.carried(df, ["k"], "at", ["x", "y"], 400, Scratch(spark, "t"), "c").select("k", "at", "x", "y", "next").collect()), key=lambda r: r[:2])
    want, x, y, data = [], None, None, sorted(data, key=lambda r: r[:2])
    for i, (k, at, new_x, new_y) in enumerate(data):
        if i == 0 or data[i - 1][0] != k:
            x = y = None
        x, y = x if new_x is None else new_x, y if new_y is None else new_y
        want.append((k, at, x, y, data[i + 1][1] if i + 1 < len(data) and data[i + 1][0] == k else None))
    assert got == want


def test_sinks_and_ids(spark, tmp_path):
    edges = spark.createDataFrame([(3, 4, 5, 5, 2), (4, 6, 1, 1, 0)], "u bigint, v bigint, cap_uv bigint, cap_vu bigint, flow bigint")
    sinks.write_flows(edges, str(tmp_path / "f"), text=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "f")).collect()] == ["3 4 2"]
    sinks.write_state(edges, str(tmp_path / "s"))
    assert sources.read_state(spark, str(tmp_path / "s")).count() == 2
    assert sorted(map(tuple, sinks.vertex_dump(edges, 4).collect())) == [(3, -2, 5), (6, 0, 1)]
    assert {r["value"] for r in sinks.edge_lines(edges).collect()} == {"3->4 2/5", "4->6 0/1"}
    key = spark.range(1).select(G.edge_key(F.lit(-5), F.lit(7)).alias("a"), G.edge_key(F.lit(7), F.lit(-5)).alias("b")).first()
    assert key["a"] == key["b"] == (-5 << 32 | 7)
    assert sorted(r["value"] for r in sinks.adjacency_lines(spark.createDataFrame([(3, 9), (3, 4)], "src bigint, dst bigint")).collect()) == ["3\tx\t4\t9"]


def test_settings():
    config = FlowConfig.parse({"sources": "3,4", "sinks": "null", "max_random_capacity": "5", "kept_paths": "none", "keep_rounds": "true"})
    assert (config.sources, config.sinks, config.max_random_capacity, config.kept_paths, config.keep_rounds) == ((3, 4), (), 5, None, True)
    scripts = {"mf.sources": "3", "mf.random.source.sink": "-1", "mf.excess.list.max": "100", "mf.sink.excess": "false", "mf.reducers": "45", "mf.round": "2", "mf.delete.prev.results": "false", "mf.zip.master": "false", "mf.max.epath.length": "20", "mf.debug": "1"}
    config = FlowConfig.parse(scripts)
    assert (config.sources, config.random_terminals, config.kept_paths, config.bidirectional, config.reducers) == ((3,), 0, 100, False, 45)
    assert (config.resume, config.keep_rounds, config.codec, config.longest_path) == (True, True, "none", 20)
    assert FlowConfig().kept_paths == 512
    for bad in ({"other": "x"}, {"mf.other": "x"}, {"keep_rounds": "yes"}):
        with pytest.raises(ValueError, match="unknown setting|neither true nor false"):
            FlowConfig.parse(bad)


def test_command_line(spark, tmp_path, capsys):
    from sluice.__main__ import main

    (tmp_path / "g.txt").write_text("3\tx\t4\t5\tbad\n4\tx\t5\n5\tx\n")
    graph, out = str(tmp_path / "g.txt"), f"file://{tmp_path}/out"
    main(["flow", graph, "-D", "mf.sources=3", "-D", "sinks=5", "--out", out, "--paths", "--text", "-D", "mf.reducers=3"])
    assert "flow 2, cut 2" in capsys.readouterr().out and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    metrics = {(r["name"]): int(r["value"]) for r in spark.read.option("sep", "\t").option("header", True).csv(f"{out}/metrics").collect()}
    assert metrics["total_flow"] == 2 and metrics["malformed"] == 1 and metrics["isolated"] == 1
    assert sum(int(r["value"].split("=")[1]) for r in spark.read.text(f"{out}/paths").collect()) == 2
    assert {r["value"] for r in spark.read.text(f"{out}/flows").collect()} >= {"3 5 1"}
    main(["flow", f"{out}/edges", "-D", "mf.round=1"])
    assert "flow 2, cut 2, sweeps 0, maximal" in capsys.readouterr().out
    main(["flow", graph, "-D", "sources=3", "-D", "sinks=5", "--method", "paths", "-D", "kept_paths=2"])
    assert "flow 2, cut 2" in capsys.readouterr().out
    main(["search", graph, "-D", "sources=3", "--out", out])
    assert {r["value"] for r in spark.read.text(f"{out}/levels").collect()} == {"1\t0", "3\t1", "4\t2", "5\t2"}
    main(["convert", graph, "--out", f"{out}/text", "--text"])
    assert {r["value"] for r in spark.read.text(f"{out}/text").collect()} == {"3\tx\t4\t5", "4\tx\t3\t5", "5\tx\t3\t4"}
    main(["convert", graph, "--out", f"{out}/arcs"])
    main(["flow", f"{out}/arcs", "--table", "src,dst", "-D", "sources=3", "-D", "sinks=5"])
    assert "flow 2, cut 2" in capsys.readouterr().out
    (tmp_path / "g.max").write_text("p max 3 2\nn 1 s\nn 3 t\na 1 2 4\na 2 3 3\n")
    main(["flow", str(tmp_path / "g.max"), "--dimacs"])
    assert "flow 3, cut 3" in capsys.readouterr().out
    with pytest.raises(ValueError, match="unknown setting"):
        main(["flow", graph, "-D", "mf.none=3"])


@pytest.mark.parametrize("seed", [1])
def test_blocks_add_up_to_a_flow_that_sweeps_finish(spark, monkeypatch, seed):
    """Whatever the blocks: what they find is a flow, and the run ends with the value and the cut of augmenting paths."""
    from sluice.plans.scratch import Scratch

    rng = random.Random(seed)
    names = range(3, 24)
    arcs = [(rng.choice(names), rng.choice(names), rng.randint(1, 9)) for _ in range(90)]
    arcs += [(1, v, rng.randint(1, 40)) for v in rng.sample(names, 6)] + [(v, 2, rng.randint(1, 40)) for v in rng.sample(names, 6)] + [(1, 2, 5), (7, 1, 3), (2, 9, 4)]
    value, side = brute_flow(arcs)
    monkeypatch.setattr(maxflow, "WHOLE_EDGES", 0)
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 20)
    edges = build.merge_parallel(frame(spark, arcs)).cache()
    found, gains = blocks.flow_in_blocks(edges, edges.count(), Scratch(spark, "b"), "b")
    assert verify.capacity_violations(found).isEmpty() and verify.conservation_violations(found).isEmpty()
    assert found.drop("flow").exceptAll(edges.drop("flow")).isEmpty() and found.count() == edges.count()
    assert 0 < maxflow.flow_value(found) == sum(gains) <= value
    result = max_flow(edges)
    assert (result.value, result.cut_value, {r["v"] for r in result.cut_side.collect()}, result.converged) == (value, value, side, True)
    assert verify.capacity_violations(result.edges).isEmpty() and verify.conservation_violations(result.edges).isEmpty()
    assert sum(n for _, name, n in result.metrics if name in ("accepted_flow", "block_flow")) == value


def test_a_hub_is_spread_over_blocks_and_its_arc_is_dealt_out(spark):
    """A star: source to hub to 40 leaves to sink. Leaves lie in many blocks, so the hub's arc is shared, and no flow is lost."""
    from sluice.plans.scratch import Scratch

    arcs = [(1, 3, 60), *((3, v, 2) for v in range(10, 50)), *((v, 2, 1 + v % 2) for v in range(10, 50))]
    edges = build.merge_parallel(frame(spark, arcs)).cache()
    scratch = Scratch(spark, "b")
    dealt = blocks.with_lower_end(edges.where("u > 2 AND v > 2"), scratch, "d")
    assert not dealt.where("by_u").count()  # leaves have one edge each
    dealt = dealt.withColumn("block", (F.col("v") % 7).cast("int"))
    parts = blocks.shares(dealt, spark.createDataFrame([(3, True, 60), (11, False, 2)], "x bigint, is_source boolean, cap bigint")).collect()
    assert sum(r["share"] for r in parts if r["is_source"]) == 60 and len({r["block"] for r in parts if r["is_source"]}) == 7
    assert [(r["block"], r["share"]) for r in parts if not r["is_source"]] == [(4, 2)]
    assert brute_flow(arcs)[0] == 60 and max_flow(edges).value == 60


def test_a_block_is_solved_to_its_maximum():
    for seed in range(20):
        rng = random.Random(seed)
        arcs = {(u, v): rng.randint(1, 9) for u, v in ((rng.randint(1, 12), rng.randint(1, 12)) for _ in range(50)) if u < v}
        u, v, cap = (np.array(c, np.int64) for c in zip(*((*e, c) for e, c in arcs.items())))
        flow = blocks.solve_block(u, v, cap, np.zeros(len(u), np.int64))
        out = [int(flow[u == x].sum() - flow[v == x].sum()) for x in range(1, 13)]
        assert (out[0], out[1]) == (brute_flow([(*e, c) for e, c in arcs.items()])[0], -out[0]) and not any(out[2:])
        assert ((0 <= flow) & (flow <= cap)).all()


def test_a_flow_that_lies_between_levels_is_taken_without_sweeps(spark, monkeypatch):
    """All arcs of the first flow lie between its levels; the second has a way of another length and takes sweeps."""
    asked = []
    held = decompose.level_flow
    monkeypatch.setattr(decompose, "level_flow", lambda *a, **b: asked.append(1) or held(*a, **b))
    flow = [(1, 3, 4), (1, 4, 2), (3, 5, 3), (3, 6, 1), (4, 6, 2), (2, 5, -3), (2, 6, -3)]
    for extra, value, sweeps in (([], 6, 0), ([(1, 7, 1), (2, 7, -1)], 7, 2)):
        edges = spark.createDataFrame([(u, v, 9, 9, n) for u, v, n in flow + extra], "u bigint, v bigint, cap_uv bigint, cap_vu bigint, flow bigint")
        rows = decompose.decompose(edges).collect()
        on = defaultdict(int)
        for r in rows:
            for h in r["path"]:
                on[h["u"], h["v"]] += r["amount"]
        assert sum(r["amount"] for r in rows) == value and len(asked) == sweeps
        assert on == {(u, v) if n > 0 else (v, u): abs(n) for u, v, n in flow + extra}
