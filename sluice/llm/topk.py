"""Exact top-k inner-product search over integer vectors by MaxScore, in shards that are merged.

Terms are the dimensions. Every shard bounds each term's contribution to a query. Terms are taken in order of how far
their contribution can vary; the essential ones are those needed before the rest alone can no longer lift a row to
the query's threshold. Essential postings are traversed for every row of the shard; the others are probed only for
rows that stay competitive, term block by term block. Rows that tie with the threshold stay, so ties are exact.

A query first searches the shard that promises most, whose k-th score is its threshold everywhere; then it is sent
only to the shards whose bound reaches that. Vectors of like signs share shards, so that bounds differ. A shard is
written once as a matrix and searched by a task that streams its queries past it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, prepare, task

#: Rows of a shard; queries that one task streams past it, at most; sign bits that tell shards apart, at most.
SHARD_ROWS, TASK_QUERIES, SIGNS = 8192, 200_000, 10
#: Bytes of the bounds of all shards that workers hold at a time, and bounds of query and shard computed at a time.
BOUND_BYTES, CELLS = 64 << 20, 1 << 22
PROBE = 8
FOUND = "query_id long, vec_id long, score long"
PACKED = "shard int, ids binary, matrix binary, width int, low binary, high binary, most double"
ROUTED = "shard int, query_id long, vector array<double>, least double"


def _dense(column) -> np.ndarray:
    """A row for each list; shorter ones count as padded with 0."""
    lists = [np.asarray(x, np.float64) for x in column]
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width))
    for row, x in zip(out, lists):
        row[: len(x)] = x
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best by score, then smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def max_score(query: np.ndarray, own: int, ids: np.ndarray, terms: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a shard that score ``least`` or more. terms: a row for each dimension; low, high: its range."""
    bound_low, bound_high = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
    order = np.argsort(bound_low - bound_high, kind="stable")
    rest = np.append(np.cumsum((bound_high - bound_low)[order][::-1])[::-1], 0.0)  # what the terms from i on can vary by
    slack = np.append(np.cumsum(bound_high[order][::-1])[::-1], 0.0)
    rows = np.arange(len(ids))
    # A threshold of the shard's own: the exact scores of the rows that are largest in the first term.
    lead = terms[order[0]] * np.sign(query[order[0]]) if len(order) else np.zeros(len(ids))
    seeds = np.argpartition(-lead, min(4 * k, len(ids) - 1))[: 4 * k]
    seeds = seeds[ids[seeds] != own]
    scores = query @ terms[:, seeds]
    threshold = max(least, np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf)
    # A row that is least in the essential terms can't reach the threshold by the others.
    essential = int(np.searchsorted(-rest, bound_low.sum() - threshold, side="right")) if np.isfinite(threshold) else len(order)
    essential = min(max(essential, 1), len(order))
    part = query[order[:essential]] @ terms[order[:essential]] if len(order) else np.zeros(len(ids))
    at = essential
    keep = (part + slack[at] >= threshold) & (ids != own)
    rows, part = rows[keep], part[keep]
    while at < len(order) and len(rows):
        step = order[at : at + PROBE]
        part = part + query[step] @ terms[np.ix_(step, rows)]
        at += len(step)
        keep = part + slack[at] >= threshold
        rows, part = rows[keep], part[keep]
    top = best(ids[rows], part, k)
    return rows[top], part[top]


def _pack(table: pa.Table) -> pa.Table:
    """A shard as a matrix with a row for each dimension, and the range of each dimension."""
    matrix = np.ascontiguousarray(_dense(table.column("vector").to_pylist()).T)
    ids = np.asarray(table.column("vec_id"), np.int64)
    ends = [matrix.min(axis=1, initial=np.inf), matrix.max(axis=1, initial=-np.inf)]
    row = (table.column("shard")[0].as_py(), ids.tobytes(), matrix.tobytes(), len(matrix), ends[0].tobytes(), ends[1].tobytes(), float(np.abs(matrix).max(initial=0)))
    types = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.float64())
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[f.split()[0] for f in PACKED.split(", ")])


@task
def _route(batches, bounds, first: bool):
    """A row for each shard that a query goes to: the one that promises most, or all whose bound reaches its least score."""
    shards, low, high = bounds.value
    width = low.shape[1]
    for batch in batches:
        ids, lists, least = np.asarray(batch.column(0)), batch.column(1).to_pylist(), np.asarray(batch.column(2))
        step = max(1, CELLS // max(1, len(shards)))
        for a in range(0, len(ids), step):
            asked = np.zeros((len(ids[a : a + step]), width))
            for row, x in zip(asked, lists[a : a + step]):
                row[: min(width, len(x))] = x[:width]  # the shards hold nothing beyond
            bound = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
            query, shard = (np.arange(len(asked)), bound.argmax(axis=1)) if first else np.nonzero(bound >= least[a : a + step, None])
            for b in range(0, len(query), 2000):
                q, own = query[b : b + 2000] + a, shards[shard[b : b + 2000]]
                columns = [pa.array(own, pa.int32()), pa.array(ids[q]), pa.array([lists[i] for i in q.tolist()], pa.list_(pa.float64())), pa.array(least[q])]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "query_id", "vector", "least"])


@task
def _search(batches, k: int):
    """Rows of a shard and part: the matrix first, then its queries."""
    for batch in batches:
        out = []
        for i, whole in enumerate(batch.column(0).to_pylist()):
            if whole:
                ids = np.frombuffer(batch.column(1)[i].as_py(), np.int64)
                terms = np.frombuffer(batch.column(2)[i].as_py(), np.float64).reshape(batch.column(3)[i].as_py(), len(ids))
                low, high = terms.min(axis=1, initial=np.inf), terms.max(axis=1, initial=-np.inf)
            else:
                own, least = batch.column(4)[i].as_py(), batch.column(6)[i].as_py()
                query = np.zeros(len(terms))
                x = batch.column(5)[i].as_py()
                query[: min(len(x), len(terms))] = x[: len(terms)]
                rows, scores = max_score(query, own, ids, terms, low, high, k, least)
                out.append((np.full(len(rows), own), ids[rows], scores.astype(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])


def searched(asked: DataFrame, shards: DataFrame, n_asked: int, k: int) -> DataFrame:
    """The best rows of each (query, shard) asked."""
    parts = max(1, -(-n_asked // TASK_QUERIES))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    none = lambda t: F.lit(None).cast(t)
    held = shards.select("shard", part, F.lit(True).alias("whole"), "ids", "matrix", "width", none("long").alias("query_id"), none("array<double>").alias("vector"), none("double").alias("least"))
    sent = asked.select("shard", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("whole"), none("binary").alias("ids"), none("binary").alias("matrix"), none("int").alias("width"), "query_id", "vector", "least")
    both = held.unionByName(sent).repartition("shard", "part").sortWithinPartitions("shard", "part", F.desc("whole"))
    return both.drop("shard", "part").mapInArrow(partial(_search, k=k), FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows; integer vectors; a row with the query's id is not its own answer.

    Rows whose id or vector is null, or whose vector holds a null, take no part; shorter vectors count as padded with
    0. Repeated ids: each row is a candidate of its own and each query row is answered once for its id. Empty tables
    give no rows. Other columns play no part. ValueError where a score might not be exact (2**53 or more).
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "topk")
    clean = lambda df, name: df.select(F.col(id_col).cast("long").alias(name), F.col(vector_col).cast("array<double>").alias("vector")).where(f"{name} IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    rows, asked = clean(vectors, "vec_id"), clean(queries, "query_id").dropDuplicates(["query_id"])
    bits = min(SIGNS, max(1, rows.count() // SHARD_ROWS).bit_length() - 1)
    cell = sum((F.when(F.get("vector", F.lit(b)) >= 0, 1 << b).otherwise(0) for b in range(bits)), F.lit(0))
    sizes = {r["cell"]: -(-r["n"] // SHARD_ROWS) for r in rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}  # of 2**bits cells
    number = [sizes.get(c, 0) for c in range(1 << bits)]
    begin = np.concatenate(([0], np.cumsum(number)[:-1])).tolist()
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (cell + 1).cast("int"))
    # A row number beside the id, so that rows of one id are dealt as well.
    shard = at(begin) + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), at(number))
    shards = rows.withColumn("shard", shard.cast("int")).groupBy("shard").applyInArrow(lambda own: _pack(own), PACKED)
    shards = scratch.table(shards, "shards")
    asked = asked.withColumn("least", F.lit(float("-inf")))
    asked, seen = scratch.counted(asked, "asked", n=F.count(F.lit(1)), most=F.max(F.expr("aggregate(vector, 0D, (m, x) -> greatest(m, abs(x)))")))
    ends = shards.agg(F.max("most").alias("most"), F.max("width").alias("width"), F.count("*").alias("n")).first()
    if (ends["most"] or 0) * (seen["most"] or 0) * (ends["width"] or 0) >= 2**53:
        raise ValueError("scores may reach 2**53, where they would not be exact")
    groups = max(1, -(-ends["n"] * (ends["width"] or 0) * 16 // BOUND_BYTES))
    found = None
    for group in range(groups if ends["n"] else 0):
        own = shards.where(F.col("shard") % groups == group)
        bounds = spark.sparkContext.broadcast(bounds_of(own, ends["width"]))
        if not group:
            home = searched(asked.mapInArrow(partial(_route, bounds=bounds, first=True), ROUTED), own, seen["n"], k)
            kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") == k)
            asked = asked.select("query_id", "vector").join(kth.select("query_id", "kth"), "query_id", "left")
            asked = scratch.table(asked.select("query_id", "vector", F.coalesce("kth", F.lit(float("-inf"))).alias("least")), "bounded")
        part = searched(asked.mapInArrow(partial(_route, bounds=bounds, first=False), ROUTED), own, seen["n"], k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.col("vec_id").alias("score"))  # there are none
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bounds_of(shards: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the shards and the least and greatest value of each dimension; at most BOUND_BYTES."""
    rows = shards.select("shard", "low", "high").collect()
    out = np.zeros((2, len(rows), width))
    for i, r in enumerate(rows):
        for side, name in enumerate(("low", "high")):
            x = np.frombuffer(r[name], np.float64)
            out[side, i, : len(x)] = x
    return np.array([r["shard"] for r in rows], np.int32), out[0], out[1]


def quantised(vectors: DataFrame, scale: int = 256, vector_col: str = "embedding") -> DataFrame:
    """floor(scale * x) of every component; null where one is null or not finite."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.withColumn(vector_col, F.when(~bad, F.transform(x, lambda v: F.floor(v.cast("double") * scale))))
