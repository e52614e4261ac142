"""Settings of a flow run."""

from __future__ import annotations

from dataclasses import dataclass

#: Reserved vertex ids, the capacity of terminal edges, and the fold of long ids.
SOURCE, SINK = 1, 2
RESERVED = (0, 1, 2)
TERMINAL_CAPACITY = 10_000_000
FOLD = 100_000_000_000_000
#: Default numbers of kept paths per vertex: the best, or as many drawn at random.
BEST_PATHS, RANDOM_PATHS = 512, 32
#: Least degree of a randomly picked terminal.
TERMINAL_DEGREE = 3000


@dataclass(frozen=True)
class FlowConfig:
    """What a run needs besides its graph.

    sources, sinks: terminal ids, joined to the super terminals. random_terminals: pick so many of each instead, above
    terminal_degree. max_random_capacity: 1 for unit capacities, else seeded capacities up to it. undirected: capacity
    in both directions. max_rounds: stop after so many sweeps (the result then says it has not converged). approx:
    stop once a sweep gains less than this share of the value. keep_rounds: keep the tables of earlier rounds.
    kept_paths: paths kept at a vertex, None for all. path_choice: keep the 'best' or 'random' ones. forward: offer
    'all' paths of a vertex over each arc, or 'one' drawn. bidirectional: paths grow from the sink too. path_rounds:
    rounds of paths before the sweeps. longest_path: hops of a path at most, None for any. resume: begin from the
    written state of a run. commit_every: rounds from one commit to the next in the journal of --out, 0 for none.
    reducers: shuffle partitions of the run, None for the session's. codec: of written state.
    """

    sources: tuple[int, ...] = ()
    sinks: tuple[int, ...] = ()
    random_terminals: int = 0
    terminal_degree: int = TERMINAL_DEGREE
    max_random_capacity: int = 1
    undirected: bool = True
    max_rounds: int | None = None
    approx: float = 0.0
    keep_rounds: bool = False
    seed: int = 0
    kept_paths: int | None = BEST_PATHS
    path_choice: str = "best"
    forward: str = "all"
    bidirectional: bool = True
    path_rounds: int = 8
    longest_path: int | None = None
    resume: bool = False
    commit_every: int = 0
    reducers: int | None = None
    codec: str = "zstd"

    @classmethod
    def parse(cls, items: dict[str, str]) -> FlowConfig:
        """From string settings, under their names here or as ``mf.*``; a setting without a meaning here raises."""
        known = {}
        for key, value in items.items():
            if key in KEYS:
                known[key] = KEYS[key](value)
            elif key in MF_KEYS:
                name, read = MF_KEYS[key]
                known[name] = read(value)
            elif key not in IDLE:
                raise ValueError(f"unknown setting {key}")
        return cls(**known)


def _ids(x: str) -> tuple[int, ...]:
    return tuple(int(i) for i in x.split(",") if i) if x and x != "null" else ()


def _flag(x: str) -> bool:
    if x.lower() not in ("true", "false"):
        raise ValueError(f"neither true nor false: {x}")
    return x.lower() == "true"


def _most(x: str) -> int | None:
    """A limit; none, null and negative numbers stand for no limit."""
    return None if x.lower() in ("none", "null", "") or int(x) < 0 else int(x)


KEYS = {
    "sources": _ids, "sinks": _ids, "random_terminals": int, "terminal_degree": int, "max_random_capacity": int, "undirected": _flag, "max_rounds": _most, "approx": float, "keep_rounds": _flag, "seed": int,
    "kept_paths": _most, "path_choice": str, "forward": str, "bidirectional": _flag, "path_rounds": int, "longest_path": _most, "resume": _flag, "commit_every": int, "reducers": _most, "codec": str,
}
#: Names of the settings in the scripts of earlier systems, and how their values read here.
MF_KEYS = {
    "mf.sources": ("sources", _ids),
    "mf.sinks": ("sinks", _ids),
    "mf.random.source.sink": ("random_terminals", lambda x: max(0, int(x))),
    "mf.max.random.capacity": ("max_random_capacity", int),
    "mf.excess.list.max": ("kept_paths", _most),
    "mf.sink.excess": ("bidirectional", _flag),
    "mf.reducers": ("reducers", _most),
    "mf.round": ("resume", lambda x: int(x) > 0),
    "mf.delete.prev.results": ("keep_rounds", lambda x: not _flag(x)),
    "mf.zip.master": ("codec", lambda x: "zstd" if _flag(x) else "none"),
    "mf.max.epath.length": ("longest_path", _most),
}
#: Settings of those scripts that change no result here; they are accepted.
IDLE = {"mf.graph", "mf.comment", "mf.rmi.host", "mf.rmi.server", "mf.input.facebook", "mf.use.sink.fragment", "mf.broadcast.attenuation", "mf.debug"}
