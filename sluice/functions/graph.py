"""Column functions on vertex ids, edges and paths.

A path is array<struct<u:bigint,v:bigint>>, one hop after the other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.plans.config import FOLD, RESERVED

PATH = "array<struct<u:bigint,v:bigint>>"


def fold_id(raw: Column, check: bool = True) -> Column:
    """A long external id as a vertex id: very large ones become negative; reserved or too wide ones are an error."""
    value = raw.try_cast("bigint")
    folded = F.when(value >= FOLD, F.lit(FOLD) - value).otherwise(value)
    if not check:
        return folded
    wrong = folded.isNull() | folded.isin(*RESERVED) | (folded < -(1 << 31)) | (folded >= 1 << 31)
    return F.when(wrong, F.raise_error(F.concat(F.lit("not a vertex id: "), F.coalesce(raw.cast("string"), F.lit("null")))).cast("bigint")).otherwise(folded)


def edge_key(u: Column, v: Column) -> Column:
    """One 64-bit key for both directions of an edge between 32-bit ids."""
    low, high = F.least(u, v).cast("bigint"), F.greatest(u, v).cast("bigint")
    return F.shiftleft(low, 32).bitwiseOR(high.bitwiseAND(F.lit((1 << 32) - 1)))


def hop(u: Column, v: Column) -> Column:
    return F.struct(u.cast("bigint").alias("u"), v.cast("bigint").alias("v"))


def empty_path() -> Column:
    return F.array().cast(PATH)


def start_of(path: Column) -> Column:
    return F.try_element_at(path, F.lit(1))["u"]


def end_of(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))["v"]


def length_of(path: Column) -> Column:
    return F.size(path)


def vertices_of(path: Column) -> Column:
    """All vertices, the start first."""
    return F.when(F.size(path) == 0, F.array().cast("array<bigint>")).otherwise(F.concat(F.array(start_of(path)), path["v"]))


def visits(path: Column, v: Column) -> Column:
    return F.array_contains(path["u"], v) | F.array_contains(path["v"], v)


def append_hop(path: Column, u: Column, v: Column) -> Column:
    return F.concat(path, F.array(hop(u, v)))


def prepend_hop(path: Column, u: Column, v: Column) -> Column:
    return F.concat(F.array(hop(u, v)), path)


def drop_first(path: Column) -> Column:
    return F.when(F.size(path) <= 1, empty_path()).otherwise(F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))))


def drop_last(path: Column) -> Column:
    return F.when(F.size(path) <= 1, empty_path()).otherwise(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))))


def join_paths(first: Column, second: Column) -> Column:
    """Both paths as one without a cycle: a hop back to a vertex of the path so far removes the loop."""

    def step(done: Column, h: Column) -> Column:
        seen = F.array_position(F.transform(done, lambda x: x["u"]), h["v"])
        return F.when(seen > 0, F.when(seen == 1, empty_path()).otherwise(F.slice(done, F.lit(1), F.greatest((seen - 1).cast("int"), F.lit(0))))).otherwise(F.concat(done, F.array(h)))

    whole = F.concat(first, second)
    vertices = vertices_of(whole)
    # Most have no loop: what Spark would interpret hop by hop is left to those that have one.
    return F.when(F.size(F.array_distinct(vertices)) == F.size(vertices), whole).otherwise(F.aggregate(whole, empty_path(), step))


def edge_text(u: Column, v: Column, flow: Column, capacity: Column) -> Column:
    return F.format_string("%d->%d %d/%d", u, v, flow, capacity)


def path_text(path: Column, amount: Column) -> Column:
    """v0:v1:...=amount."""
    return F.concat(F.array_join(vertices_of(path).cast("array<string>"), ":"), F.lit("="), amount.cast("string"))
