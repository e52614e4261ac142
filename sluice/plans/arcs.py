"""Residual arcs that stay in place while flow changes them: a base in buckets, and a log of changes beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.scratch import Dealt, Scratch

#: Arcs asked for in a bucket up to which a task may hold them in a hash table (some 200 MB).
ASKED_ARCS = 1 << 21
#: A log of more rows than this share of the base's, or of more additions, is merged into a new base.
LOG_SHARE, LOG_ADDITIONS = 0.5, 24


class ArcLog:
    """src, dst, res in buckets by one end. Arcs are exchanged once; after that only changes are.

    A change is a row (src, dst, by how much) in the bucket of its arc; reading adds the rows of an arc up, where they
    lie. Merging reads and writes buckets as they are, without an exchange.
    """

    def __init__(self, scratch: Scratch, label: str, arcs: DataFrame, key: str = "src"):
        self.scratch, self.label, self.key, self.generation = scratch, label, key, 0
        self.held = Dealt(scratch, f"{label}-0", key)
        self.held.add(arcs.select("src", "dst", "res"))
        self.rows_held, self.rows_changed, self.additions = None, 0, 0

    def change(self, flow: DataFrame, rows: int, back: bool = True) -> None:
        """Take a flow src, dst, flow (of so many rows) off its arcs and add it to the arcs back, unless not ``back``."""
        taken = F.struct("src", "dst", (-F.col("flow")).alias("res"))
        given = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("flow").alias("res"))
        changes = [taken, given] if back else [taken]
        self.held.add(flow.select(F.inline(F.array(*changes))))
        self.rows_changed, self.additions = self.rows_changed + len(changes) * rows, self.additions + 1
        if self.rows_held is None:
            self.rows_held = self.held.read().count() - self.rows_changed  # from the footers of the files
        if self.rows_changed > LOG_SHARE * self.rows_held or self.additions > LOG_ADDITIONS:
            self.merge()

    def merge(self) -> None:
        """Base and log become a new base."""
        self.generation += 1
        merged = Dealt(self.scratch, f"{self.label}-{self.generation}", self.key)
        merged.add(self.rows(), in_place=True)
        self.held.close(delete=True)
        self.held, self.rows_held, self.rows_changed, self.additions = merged, None, 0, 0

    def rows(self, near: DataFrame | None = None) -> DataFrame:
        """The arcs with residual capacity now; only those whose key is that of a row of ``near``, with its columns."""
        rows = self.held.read()
        extra = []
        if near is not None:
            rows, extra = rows.join(near, self.key), [c for c in near.columns if c != self.key]
        if self.additions:
            rows = rows.groupBy("src", "dst", *extra).agg(F.sum("res").alias("res"))
        return rows.where("res > 0").select("src", "dst", "res", *extra)

    def among(self, asked: DataFrame, most: int) -> DataFrame:
        """``asked`` (src, dst, once each, and further columns; ``most`` rows at most) with the res of each arc now, 0 if it has none.

        Only the rows of these arcs are added up. Within ``in_buckets`` the arcs stay where they are.
        """
        if most <= ASKED_ARCS * self.held.buckets:
            asked = asked.hint("shuffle_hash")
        rows, extra = self.held.read().join(asked, ["src", "dst"], "right"), [c for c in asked.columns if c not in ("src", "dst")]
        return rows.groupBy("src", "dst", *extra).agg(F.coalesce(F.sum("res"), F.lit(0)).cast("bigint").alias("res"))

    def close(self) -> None:
        self.held.close(delete=True)
