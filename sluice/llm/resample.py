"""Importance resampling of documents toward a target.

Two generative models over hashed word unigrams and bigrams, one of target documents and one of the raw corpus, give
each document a log importance weight, the ratio of the two for its whole text; adding Gumbel noise to it and keeping
the k largest draws k documents without replacement in proportion to their weights. A target document is weighed by
models without itself, so that it gains nothing from having been learned. The k-th largest key is found by refining
histograms, so no task or driver holds the keys.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import TABLE_ROWS, U64, Scratch, byte_rows, mix, pieces, prepare, span_hash, sum_tables, table_batches, task, word_spans

BUCKETS = 1 << 16
#: Made-up occurrences of each feature at its rate in the raw corpus: what the target shows of rare features is shrunk.
SMOOTH = 4.0
#: Labelled good documents that the target model is fitted on, at most; a seeded random sample where there are more.
TARGET_ROWS = 100_000
#: Share of the rows that is drawn.
SHARE = 0.5
BINS = 4096


def features(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every hashed word and word pair, A-Z folded."""
    data, starts, ends, row = word_spans(rows)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = span_hash(data, starts, ends)
    with np.errstate(over="ignore"):
        pair = mix(word[:-1] * U64(0x9E3779B97F4A7C15) + word[1:])[row[:-1] == row[1:]]
    both = np.concatenate([word, pair])
    return np.concatenate([row, row[:-1][row[:-1] == row[1:]]]), (mix(both) & U64(BUCKETS - 1)).astype(np.int64)


@task
def _count(batches, ids):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        wanted, rows = batch.column(0).is_valid().to_numpy(zero_copy_only=False), byte_rows(batch.column(1))
        wanted &= np.isin(np.asarray(batch.column(0).fill_null(0), np.int64), ids.value)
        for a, b in pieces(rows):
            row, bucket = features(rows[a:b])
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[wanted[a:b][row]], minlength=BUCKETS)
    yield from table_batches({"raw": raw, "target": target})


def log_ratios(raw: np.ndarray, target: np.ndarray, raw_total: float, target_total: float) -> np.ndarray:
    """Log ratio of the target model to the raw one for features with these counts."""
    return np.log((target + SMOOTH) / (raw * target_total / max(raw_total, 1) + SMOOTH))


def without_itself(bucket: np.ndarray, raw: np.ndarray, target: np.ndarray, raw_total: float, target_total: float) -> float:
    """Log ratio of a target document's features by models from which its own counts are deleted."""
    own, times = np.unique(bucket, return_counts=True)
    n = len(bucket)
    return float(times @ log_ratios(raw[own] - times, target[own] - times, raw_total - n, target_total - n))


@task
def _weigh(batches, model):
    raw, target, ids = model.value
    totals = raw.sum(), target.sum()
    ratio = log_ratios(raw, target, *totals)
    for batch in batches:
        rows = byte_rows(batch.column(1))
        learned = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & np.isin(np.asarray(batch.column(0).fill_null(0), np.int64), ids)
        weight, n = np.zeros(len(rows)), np.zeros(len(rows))
        for a, b in pieces(rows):
            row, bucket = features(rows[a:b])
            weight[a:b] = np.bincount(row, ratio[bucket], b - a)
            n[a:b] = np.bincount(row, minlength=b - a)
            known = learned[a:b][row]
            of, own = row[known], bucket[known]
            order = np.argsort(of, kind="stable")
            of, own = of[order], own[order]
            at = np.flatnonzero(np.diff(of, prepend=-1))
            for first, last in zip(at, [*at[1:], len(of)]):
                weight[a + of[first]] = without_itself(own[first:last], raw, target, *totals)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.array(weight)], names=["doc_id", "salt", "n_features", "log_weight"])


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a double column, by histograms of BINS cells that close in on it."""
    ends = keys.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high, above = ends["low"], ends["high"], 0
    while low < high:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high))
        cell = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        bins = {r["cell"]: (r["n"], r["low"], r["high"]) for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for at in sorted(bins, reverse=True):
            n, low, high = bins[at]
            if above + n >= k:
                break
            above += n
    return high


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key, selected of every row.

    Target documents are those that some label calls good (quality 1) and none calls toxic, up to TARGET_ROWS. The
    weight is the log ratio of a document's hashed word unigrams and bigrams under the target and the raw model.
    ceil(share * rows) rows are selected; equal keys at the limit are all kept. Null and empty texts weigh 0 and take
    part in the draw. Without target rows all weights are 0. Repeated rows draw the same key; a null id is no target;
    an empty table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "resample")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good = good.where("quality = 1 AND toxic = 0").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(TARGET_ROWS)
    ids = spark.sparkContext.broadcast(np.array(sorted(r["doc_id"] for r in good.collect()), np.int64))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tables = sum_tables(rows.mapInArrow(partial(_count, ids=ids), TABLE_ROWS), BUCKETS)
    raw, target = (tables.get(k, np.zeros(BUCKETS, np.int64)).astype(float) for k in ("raw", "target"))
    model = spark.sparkContext.broadcast((raw, target, ids.value))
    salted = rows.select("doc_id", "text", F.xxhash64("doc_id", F.lit(seed)).alias("salt"))
    weighed = salted.mapInArrow(partial(_weigh, model=model), "doc_id long, salt long, n_features long, log_weight double")
    uniform = (F.pmod("salt", F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    keyed = scratch.table(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))).drop("salt"), "keys")
    n = keyed.count()
    bar = kth_largest(keyed, "gumbel_key", -(-int(n * share * 1_000_000) // 1_000_000)) if n else 0.0
    return keyed.withColumn("selected", F.col("gumbel_key") >= bar)
