"""Best-fit packing of documents into fixed-length sequences, after Martello-Toth dominance reduction.

Sizes lie between 1 and the sequence length, so the whole packing problem is the count of pieces of each size: at
most ``capacity`` numbers however many documents there are. The driver solves that bounded problem and hands back
runs ("pieces of this size with these ranks go to these sequences at this offset"); the pieces look up their place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, byte_rows, pieces, prepare, task
from sluice.llm.tokens import MEMO_SEGMENTS, Encoder

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Segments that a worker keeps and text bytes that it encodes at a time; the second where memory is short.
ENCODING = {False: (MEMO_SEGMENTS, 4 << 20), True: (200_000, 1 << 20)}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"


def reduce_dominant(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Fix sequences that dominate every alternative for their largest piece; the pieces that remain.

    With R what the piece leaves free, its set is fixed if
    nothing else fits; or a piece of exactly R exists (every other filling totals at most R, so it could be swapped
    against that piece); or at most one other piece fits (the largest that fits is best); or at most two others fit
    and, for the best pair (a, b), every other pair has its smaller part at most b or its total at most a.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def smallest(k: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(left[s], k - len(out))
            if len(out) == k:
                break
        return out

    def take(times: int, members: tuple[int, ...]) -> None:
        fixed.append((times, members))
        for s in members:
            left[s] -= times
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))

    sizes = sorted(left)
    changed = True
    while changed:
        changed = False
        for size in sorted(left, reverse=True):
            while size in left:
                room = capacity - size
                left[size] -= 1  # one of them is placed; the others are candidates like any
                low = smallest(3)
                left[size] += 1
                if not low or low[0] > room:
                    take(left[size], (size,))
                elif room in left and (room != size or left[size] > 1):
                    take(left[size] // 2 if room == size else min(left[size], left[room]), (size, room))
                else:
                    fits = [s for s in sizes[: bisect_left(sizes, room + 1)] if s != size or left[s] > 1]
                    best = fits[-1]
                    if len(low) < 2 or low[0] + low[1] > room:
                        take(left[size] // 2 if best == size else min(left[size], left[best]), (size, best))
                    elif (len(low) < 3 or sum(low) > room) and (pair := _best_pair(size, best, room, left, sizes)):
                        take(1, (size, *pair))
                    else:
                        break
                changed = True
    return fixed, left


def _best_pair(size: int, a: int, room: int, left: dict[int, int], sizes: list[int]) -> tuple[int, int] | None:
    spare = lambda s, used: left.get(s, 0) - (s == size) - used.count(s) > 0
    b = next((s for s in reversed(sizes[: bisect_left(sizes, room - a + 1)]) if spare(s, (a,))), None)
    if b is None:
        return None
    for q in reversed(sizes[: bisect_left(sizes, room // 2 + 1)]):
        if q <= b:
            break
        if spare(q, ()) and any(p + q > a and spare(p, (q,)) for p in sizes[bisect_left(sizes, q) : bisect_left(sizes, room - q + 1)]):
            return None
    return a, b


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over size counts: equal sequences are kept as one group, so the work follows the sizes."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, times: int, members: tuple[int, ...]) -> None:
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append((times, members))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            room = rooms[at] if at < len(rooms) else capacity
            per = room // size
            if at < len(rooms):
                times, members = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            else:
                times, members = -(-n // per), ()
            whole = min(times, n // per)
            if whole:
                put(room - per * size, whole, members + (size,) * per)
                n -= whole * per
            if whole < times and n:
                part = min(n, per)
                put(room - part * size, 1, members + (size,) * part)
                n -= part
                whole += 1
            if whole < times and members:
                put(room, times - whole, members)
    return [g for room in rooms for g in by_room[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs (size, first rank, first sequence, offset), sorted by size and rank."""
    fixed, rest = reduce_dominant(counts, capacity)
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, members in fixed + best_fit(rest, capacity):
        offset = 0
        for size in members:
            rows.append((size, used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("size", "rank", "sequence", "offset"), table.T)) | {"sequences": np.array([sequence])}


@task
def _cut(batches, vocabulary: str, capacity: int, frugal: bool = False):
    most, size = ENCODING[frugal]
    encoder, seen, task = Encoder.get(vocabulary, False, most), defaultdict(int), TaskContext.get().partitionId()
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), byte_rows(batch.column(1))
        for first, last in pieces(rows, size):
            out = []
            for doc, coded in zip(ids[first:last], encoder.encode(rows[first:last])):
                coded = coded.tobytes() + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    length = len(part) // 4
                    out.append((doc, piece, at // 4, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [f.split()[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


@task
def _place(batches, runs: dict[str, np.ndarray]):
    key = runs["size"] << 40 | runs["rank"]
    for batch in batches:
        size, rank = (np.asarray(batch.column(i)) for i in (3, 5))
        at = np.searchsorted(key, size << 40 | rank, side="right") - 1
        sequence = runs["sequence"][at] + rank - runs["rank"][at]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(runs["offset"][at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, frugal: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and an end id 0; only longer ones than ``capacity`` are cut. Null and empty texts
    are the end id alone; equal rows are packed each by itself; an empty table gives no rows; a null id is kept.
    frugal: workers take some 150 MB less and longer, for executors whose memory operators before have taken.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = scratch.table(rows.mapInArrow(partial(_cut, vocabulary=vocabulary, capacity=capacity, frugal=frugal), PIECES), "pieces")
    # Ranks within a size: those of the task, after the counts of the tasks before it (tasks x sizes rows).
    counts = scratch.table(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    runs = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = counts.withColumn("before", F.expr("sum(n) OVER (PARTITION BY length ORDER BY task ROWS UNBOUNDED PRECEDING) - n")).select("length", "task", "before")
    ranked = cut.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(partial(_place, runs=runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
