"""Hard negatives of anchors by dual-tree search over integer vectors.

Anchors and candidates are laid out by label and the signs of their leading components, and cut into blocks of bounded
size, each written once as a matrix with its centre, radius and range of labels. A task holds one block of candidates
and streams blocks of anchors past it. It grows a tree over each: nodes are parted by label first, then along their
widest component. For a pair of nodes the inner products lie in an interval given by centres and radii; the pair is
dropped, with all anchors and candidates in it, if the interval misses every window of its anchors, if no score in it
could still enter their lists, or if its labels can't fit. Pairs of leaves are scored exactly. Whole blocks meet by the
same interval, so anchors only travel to blocks that might hold something for them.

A search fills slots: an anchor, a window of scores, and the k best candidates of its own (or of another) label.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, prepare, task

#: Rows of a block of candidates and of anchors, rows of a leaf of either, and components whose signs order the rows.
BLOCK_ROWS, ANCHOR_ROWS, LEAF, ANCHOR_LEAF, SIGNS = 8_192, 1_024, 256, 32, 8
#: Blocks of candidates whose bounds workers hold at a time, by their bytes; anchor blocks that one task takes.
BOUND_BYTES, TASK_BLOCKS = 64 << 20, 256
#: Every score is below this, so that doubles add them exactly; also the ends of a window without limits.
EXACT = 1 << 53
NO_ID = (1 << 63) - 1
PACKED = "block long, ids binary, labels binary, matrix binary, width int, centre binary, radius double, first_label long, last_label long, slots array<array<long>>"
FOUND = "anchor_id long, tag long, vec_id long, score long"


def centre_of(points: np.ndarray) -> tuple[np.ndarray, float]:
    centre = points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
    return centre, float(np.sqrt(((points - centre) ** 2).sum(axis=1).max(initial=0))) * (1 + 1e-9)


def interval(a: tuple[np.ndarray, float], b: tuple[np.ndarray, float]) -> tuple[float, float]:
    """Least and greatest inner product of points of two balls, with room for rounding."""
    middle = float(a[0] @ b[0])
    reach = np.linalg.norm(a[0]) * b[1] + np.linalg.norm(b[0]) * a[1] + a[1] * b[1]
    reach += 1e-9 * (abs(middle) + reach) + 1e-6
    return middle - reach, middle + reach


class Tree:
    """Nodes over rows laid out in ``order``: begin, end, ball, range of labels and the two children (none: a leaf)."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, leaf: int):
        self.order, self.begin, self.end, self.ball, self.labels, self.children = np.arange(len(points)), [], [], [], [], []
        waiting = [(0, len(points), -1)]
        while waiting:
            begin, end, parent = waiting.pop()
            rows, node = self.order[begin:end], len(self.begin)
            if parent >= 0:
                self.children[parent].append(node)
            first, last = int(labels[rows].min()), int(labels[rows].max())
            self.begin.append(begin), self.end.append(end), self.ball.append(centre_of(points[rows])), self.labels.append((first, last)), self.children.append([])
            if end - begin <= leaf:
                continue
            if first < last:  # the labels part at the end of one, near the middle
                key = np.sort(labels[rows])
                middle = key[len(key) // 2]
                at = int(np.searchsorted(key, middle)) or int(np.searchsorted(key, middle, side="right"))
                self.order[begin:end] = rows[np.argsort(labels[rows], kind="stable")]
            else:
                widest = int(np.argmax(np.ptp(points[rows], axis=0)))
                at = (end - begin) // 2
                self.order[begin:end] = rows[np.argpartition(points[rows, widest], at)]
            waiting += [(begin, begin + at, node), (begin + at, end, node)]
        self.norm = [float(np.linalg.norm(c)) for c, _ in self.ball]


@dataclass
class Slots:
    """Windows of anchors in the order of their tree, and the k best found for each: score, then smaller id.

    A score of ``low`` fits up to the id ``last`` only.
    """

    anchor: np.ndarray  # ascending
    low: np.ndarray
    last: np.ndarray
    high: np.ndarray
    k: int

    def __post_init__(self):
        n = len(self.anchor)
        self.scores, self.ids = np.full((n, self.k), -EXACT, np.int64), np.full((n, self.k), NO_ID)

    def least(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """What a candidate must reach for each slot, the window or the k-th best, and its greatest id if it is no better."""
        low, last, kth, own = self.low[a:b], self.last[a:b], self.scores[a:b, -1], self.ids[a:b, -1]
        return np.maximum(low, kth), np.where(kth > low, own, np.where(kth == low, np.minimum(own, last), last))

    def offer(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[slot], scores), np.append(self.ids[slot], ids)
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores[slot], self.ids[slot] = scores[best], ids[best]


def dual_search(anchors: Tree, rows: Tree, a_points: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, c_points: np.ndarray, c_ids: np.ndarray, c_labels: np.ndarray, slots: Slots, same: bool) -> int:
    """Fill the slots from all rows; points, ids and labels in the order of the trees. The pairs of leaves scored."""
    first_slot = np.searchsorted(slots.anchor, np.arange(len(a_ids) + 1))
    waiting, scored = [(0, 0, *interval(anchors.ball[0], rows.ball[0]))], 0
    while waiting:
        a, c, low, high = waiting.pop()
        s, e = first_slot[anchors.begin[a]], first_slot[anchors.end[a]]
        (f, g), (h, i) = anchors.labels[a], rows.labels[c]
        if s == e or (same and (g < h or i < f)) or (not same and f == g == h == i):
            continue
        need, last = slots.least(s, e)
        if not ((high >= need) & (low <= slots.high[s:e])).any():
            continue
        down_a, down_c = anchors.children[a], rows.children[c]
        if down_a or down_c:
            wide_a = down_a and (not down_c or anchors.ball[a][1] * rows.norm[c] > rows.ball[c][1] * anchors.norm[a])
            pairs = [(x, c) for x in down_a] if wide_a else [(a, x) for x in down_c]
            # The pair that promises most is taken first, so that lists fill with high scores early.
            waiting += sorted(((x, y, *interval(anchors.ball[x], rows.ball[y])) for x, y in pairs), key=lambda p: p[3])
            continue
        scored += 1
        own, span = slice(anchors.begin[a], anchors.end[a]), slice(rows.begin[c], rows.end[c])
        score = a_points[own] @ c_points[span].T
        fits = (a_labels[own, None] == c_labels[None, span]) == same
        if same:
            fits &= a_ids[own, None] != c_ids[None, span]
        of = slots.anchor[s:e] - anchors.begin[a]
        own = score[of]
        hits = fits[of] & ((own > need[:, None]) | ((own == need[:, None]) & (c_ids[None, span] <= last[:, None]))) & (own <= slots.high[s:e, None])
        for j in np.flatnonzero(hits.any(axis=1)).tolist():
            at = np.flatnonzero(hits[j])
            slots.offer(s + j, own[j, at].astype(np.int64), c_ids[span][at])
    return scored


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row for each list; shorter ones count as padded with 0."""
    lists = column.combine_chunks()
    ends, values = lists.offsets.to_numpy().astype(np.int64), np.asarray(lists.values, np.float64)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values[ends[0] : ends[-1]]
    return out


@task
def _pack(batches, rows: int):
    """Blocks of consecutive rows: vec_id, label, vector, slots."""
    held, count, size = [], 0, 0

    def block(table: pa.Table) -> pa.RecordBatch:
        points = _matrix(table.column("vector"))
        labels = np.asarray(table.column("label"), np.int64)
        centre, radius = centre_of(points)
        number = TaskContext.get().partitionId() << 32 | count
        slots = [[place, *slot] for place, own in enumerate(table.column("slots").to_pylist()) for slot in own]
        row = (number, np.asarray(table.column("vec_id"), np.int64).tobytes(), labels.tobytes(), points.tobytes(), points.shape[1], centre.tobytes(), radius, int(labels.min()), int(labels.max()), slots)
        types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[f.split()[0] for f in PACKED.split(", ")])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - size)
            held.append(part)
            at, size = at + part.num_rows, size + part.num_rows
            if size == rows:
                yield block(pa.Table.from_batches(held))
                held, count, size = [], count + 1, 0
    if size:
        yield block(pa.Table.from_batches(held))


def blocks(rows: DataFrame, size: int, scratch: Scratch, name: str) -> DataFrame:
    """vec_id, label, vector, slots in blocks of at most ``size`` rows, neighbours by label and signs together."""
    signs = F.concat(*(F.when(F.get("vector", F.lit(i)) >= 0, "1").otherwise("0") for i in range(SIGNS)))
    laid = rows.select("*", signs.alias("signs"), F.xxhash64("vector").alias("deal"))
    # Ranges end anywhere within a label or a group of copies, so one of a third of all rows is dealt over many of them.
    order = ["label", "signs", "deal", "vec_id"]
    # Their number follows the rows: many small blocks would each hold k candidates of a slot that has better ones elsewhere.
    laid = laid.repartitionByRange(max(1, -(-rows.count() // size)), *order).sortWithinPartitions(*order).select("vec_id", "label", "vector", "slots")
    return scratch.table(laid.mapInArrow(partial(_pack, rows=size), PACKED), name)


def _bounds(held: DataFrame) -> list[tuple]:
    """Number, ball and labels of each block."""
    return [(r["block"], np.frombuffer(r["centre"]), r["radius"], r["first_label"], r["last_label"]) for r in held.select("block", "centre", "radius", "first_label", "last_label").collect()]


def _pad(x: np.ndarray, width: int) -> np.ndarray:
    return np.append(x, np.zeros(width - len(x)))


@task
def _meet(batches, bounds, same: bool, home: bool):
    """target, block for each block of candidates that an anchor block has to meet, or for the most promising one."""
    held = bounds.value
    for batch in batches:
        columns = batch.to_pydict()
        for i, block in enumerate(columns["block"]):
            windows = np.array(columns["slots"][i], np.int64).reshape(-1, 5)
            centre, first, last = np.frombuffer(columns["centre"][i]), columns["first_label"][i], columns["last_label"][i]
            out = []
            for target, other, radius, h, j in held:
                width = max(len(other), len(centre))
                low, high = interval((_pad(centre, width), columns["radius"][i]), (_pad(other, width), radius))
                label_fits = not (last < h or j < first) if same else not first == last == h == j
                if label_fits and ((high >= windows[:, 1]) & (low <= windows[:, 2])).any():
                    out.append((-high, target))
            out = [min(out)] if home and out else out
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([t for _, t in out], pa.int64()), pa.array([block] * len(out), pa.int64())], names=["target", "block"])


class _Block:
    """A packed block with its tree."""

    def __init__(self, row: dict, leaf: int, width: int):
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        points = np.frombuffer(row["matrix"]).reshape(len(ids), row["width"])
        points = np.pad(points, ((0, 0), (0, width - row["width"])))
        self.tree = Tree(points, labels, leaf)
        self.points, self.ids, self.labels = points[self.tree.order], ids[self.tree.order], labels[self.tree.order]


@task
def _search(batches, k: int, same: bool, width: int):
    """Rows of a block of candidates first, then of the anchor blocks that meet it."""
    own, number = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            if row["held"]:
                own, number = _Block(row, LEAF, width), row["target"]
                continue
            if row["target"] != number:
                raise ValueError("an anchor block without its block of candidates")
            asked = _Block(row, ANCHOR_LEAF, width)
            windows = np.array(row["slots"], np.int64).reshape(-1, 5)  # anchor's place, low, high, tag, last
            place = np.empty(len(asked.ids), np.int64)
            place[asked.tree.order] = np.arange(len(asked.ids))
            by = np.argsort(place[windows[:, 0]], kind="stable")
            windows, anchor = windows[by], place[windows[by, 0]]
            slots = Slots(anchor, windows[:, 1], windows[:, 4], windows[:, 2], k)
            dual_search(asked.tree, own.tree, asked.points, asked.ids, asked.labels, own.points, own.ids, own.labels, slots, same)
            slot, rank = np.nonzero(slots.scores > -EXACT)
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[anchor[slot]]), pa.array(windows[slot, 3]), pa.array(slots.ids[slot, rank]), pa.array(slots.scores[slot, rank])], names=["anchor_id", "tag", "vec_id", "score"])


def search(asked: DataFrame, held: DataFrame, k: int, same: bool, width: int, home: bool = False) -> DataFrame:
    """anchor_id, tag, rank, vec_id, score: the k best of every slot, from all blocks or only from the most promising."""
    spark, found = held.sparkSession, None
    groups = max(1, -(-held.count() * 8 * (width + 8) // BOUND_BYTES))
    parts = max(1, -(-asked.count() // TASK_BLOCKS))
    columns = ["ids", "labels", "matrix", "width", "slots"]
    for group in range(groups):
        own = held.where(F.pmod(F.xxhash64("block"), F.lit(groups)) == group)
        bounds = spark.sparkContext.broadcast(_bounds(own))
        outline = asked.select("block", "centre", "radius", "first_label", "last_label", "slots")
        met = outline.mapInArrow(partial(_meet, bounds=bounds, same=same, home=home), "target long, block long")
        part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
        sent = asked.join(met, "block").select("target", part, F.lit(False).alias("held"), *columns)
        waiting = own.select(F.col("block").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("held"), *columns)
        both = waiting.unionByName(sent).repartition("target", "part").sortWithinPartitions("target", "part", F.desc("held"))
        rows = both.drop("part").mapInArrow(partial(_search, k=k, same=same, width=width), FOUND)
        found = rows if found is None else found.unionByName(rows)
    rank = F.row_number().over(W.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "tag", "rank", "vec_id", "score")


def best(anchors: DataFrame, slots: DataFrame, held: DataFrame, k: int, same: bool, width: int, scratch: Scratch, name: str) -> DataFrame:
    """``search`` for slots vec_id, low, high, tag; what the most promising block holds is each slot's first bound."""

    def laid(some: DataFrame, label: str) -> DataFrame:
        of_anchor = some.groupBy("vec_id").agg(F.collect_list(F.array("low", "high", "tag", "last")).alias("slots"))
        return blocks(anchors.join(of_anchor, "vec_id"), ANCHOR_ROWS, scratch, f"{name}/{label}")

    slots = slots.withColumn("last", F.lit(NO_ID))
    # Written, since laying out what comes of it reads it several times.
    home = scratch.table(search(laid(slots, "first"), held, k, same, width, home=True), f"{name}/home")
    kth = home.where(F.col("rank") == k).select(F.col("anchor_id").alias("anchor"), "tag", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id")).withColumnRenamed("anchor", "vec_id")
    bounded = slots.join(kth, ["vec_id", "tag"], "left")
    bounded = scratch.table(bounded.select("vec_id", F.greatest("low", "kth").alias("low"), "high", "tag", F.coalesce("kth_id", "last").alias("last")), f"{name}/slots")
    return scratch.table(search(laid(bounded, "then"), held, k, same, width), f"{name}/found")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of integer vectors, a score is the inner product with the anchor; higher ones come first, then smaller ids. An
    anchor's positives are its first ``positives`` other rows of its label; for each the first ``negatives`` rows of
    other labels with a score of ``least`` to ``most`` percent of the positive's, so a positive below 0 has none.

    Rows with a null id, label or vector, or a null in the vector, take no part; shorter vectors count as padded with
    0. Each row of a repeated id is a candidate, never a positive of its own id; an anchor id is answered once, for its
    least row by label, then vector. Fewer candidates give fewer rows, empty tables none; other columns play no part.
    ValueError where a score might not be exact (2**53 or more).
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "mining")
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("vector")).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    rows = clean(vectors)
    ends = rows.agg(F.max(F.size("vector")).alias("width"), F.max(F.expr("aggregate(vector, 0L, (m, x) -> greatest(m, abs(x)))")).alias("most")).first()
    width = ends["width"] or 0
    asked = clean(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own")).select("vec_id", "own.label", "own.vector")
    asked = scratch.table(asked, "anchors")
    reach = asked.agg(F.max(F.size("vector")).alias("width"), F.max(F.expr("aggregate(vector, 0L, (m, x) -> greatest(m, abs(x)))")).alias("most")).first()
    if (ends["most"] or 0) * (reach["most"] or 0) * width >= EXACT:
        raise ValueError("scores may reach 2**53, where they would not be exact")
    width = max(width, reach["width"] or 0)
    held = blocks(rows.withColumn("slots", F.array().cast("array<array<long>>")), BLOCK_ROWS, scratch, "candidates")
    whole = asked.select("vec_id", F.lit(-EXACT).alias("low"), F.lit(EXACT).alias("high"), F.lit(0).cast("long").alias("tag"))
    near = best(asked, whole, held, positives, True, width, scratch, "positives").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score"))
    score = F.col("positive_score")
    windows = near.where(score >= 0).select(F.col("anchor_id").alias("vec_id"), score.alias("tag")).distinct()
    windows = windows.select("vec_id", F.expr(f"({least} * tag + 99) div 100").alias("low"), F.expr(f"{most} * tag div 100").alias("high"), "tag")
    far = best(asked, windows, held, negatives, False, width, scratch, "negatives").select("anchor_id", F.col("tag").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
