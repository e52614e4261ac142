"""Prefix sums and values carried along within a key, also where one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.plans.scratch import Scratch

#: A key with more rows than this is taken in ranges of its order, so that no task gathers it.
WHOLE_KEY = 200_000


def prefix_sums(df: DataFrame, key: list[str], order: list, value: str, most: int, scratch: Scratch, label: str, out: str = "before") -> DataFrame:
    """``out``: sum of ``value`` over the rows of the same key that come before. most: rows of the largest key."""
    first = W.unboundedPreceding
    if most <= WHOLE_KEY:
        before = F.sum(value).over(W.partitionBy(*key).orderBy(*order).rowsBetween(first, -1))
        return df.withColumn(out, F.coalesce(before, F.lit(0)).cast("bigint"))
    # Ranges of (key, order) cut a large key where it is; their numbers ascend with the order.
    rows = scratch.table(df.repartitionByRange(*key, *order).withColumn("prefix_range", F.spark_partition_id()), f"{label}/ranges")
    sums = rows.groupBy(*key, "prefix_range").agg(F.sum(value).alias("prefix_total"))
    earlier = F.sum("prefix_total").over(W.partitionBy(*key).orderBy("prefix_range").rowsBetween(first, -1))
    offsets = sums.select(*key, "prefix_range", F.coalesce(earlier, F.lit(0)).alias("prefix_offset"))
    inner = F.sum(value).over(W.partitionBy(*key, "prefix_range").orderBy(*order).rowsBetween(first, -1))
    summed = rows.withColumn("prefix_inner", F.coalesce(inner, F.lit(0))).join(offsets, [*key, "prefix_range"])
    return summed.withColumn(out, (F.col("prefix_offset") + F.col("prefix_inner")).cast("bigint")).drop("prefix_range", "prefix_inner", "prefix_offset")


def carried(df: DataFrame, key: list[str], at: str, columns: list[str], most: int, scratch: Scratch, label: str, after: str = "next") -> DataFrame:
    """``columns`` with nulls filled by the last value before them in the order of ``at``, and ``after``, the next ``at``.

    ``at`` is unique within a key. most: rows of the largest key.
    """
    if most <= WHOLE_KEY:
        w = W.partitionBy(*key).orderBy(at)
        return df.withColumns({after: F.lead(at).over(w), **{c: F.last(c, ignorenulls=True).over(w) for c in columns}})
    # As in prefix_sums; of each range its first place and last values go on to the neighbouring ones.
    rows = scratch.table(df.repartitionByRange(*key, at).withColumn("prefix_range", F.spark_partition_id()), f"{label}/ranges")
    lasts = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"prefix_{c}") for c in columns]
    ranges = rows.groupBy(*key, "prefix_range").agg(F.min(at).alias("prefix_first"), *lasts)
    w = W.partitionBy(*key).orderBy("prefix_range")
    earlier = {f"prefix_{c}": F.last(f"prefix_{c}", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)) for c in columns}
    ranges = ranges.withColumns({**earlier, "prefix_first": F.lead("prefix_first").over(w)})
    inner = W.partitionBy(*key, "prefix_range").orderBy(at)
    filled = rows.withColumns({after: F.lead(at).over(inner), **{c: F.last(c, ignorenulls=True).over(inner) for c in columns}})
    filled = filled.join(ranges, [*key, "prefix_range"])
    whole = {after: F.coalesce(after, "prefix_first"), **{c: F.coalesce(c, f"prefix_{c}") for c in columns}}
    return filled.withColumns(whole).drop("prefix_range", "prefix_first", *(f"prefix_{c}" for c in columns))
