"""Audit of how document filters interact, from Walsh-Hadamard sums.

A document's mask has a bit for each filter that it fails. Of every part and label the sums of the 32 signs
(-1) ** bits(mask & w) are aggregated; the transform of these sums, divided by 32, is exactly the number of documents
of each mask. All orders of the filters are then evaluated on these 32 cells alone, whatever the number of documents:
what an order removes at a step are the cells that fail its filter and none before it, and a document that fails k
filters is removed by each of them in 120 / k of the orders, which is the Shapley value times 120.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(order) for order in itertools.permutations(FILTERS)]
#: Least words; least share of distinct words and greatest of capitals, in percent; signs that a text must not hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails each of the filters that look at it alone."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": F.lit(100).cast("long") * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SIGNS),
    }


def masked(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, good, toxic, mask of every document, one row each; texts are read once, and compared by their SHA-256."""
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in failures(F.col("whole")).items()), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("whole"))
    rows = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("whole").cast("binary"), 256)).alias("same"))
    rows = scratch.table(rows, "masks")
    known = rows.where("doc_id IS NOT NULL")
    # The first id of a text meets its own rows by id and text, so copies of one text are dealt like any other rows.
    first = known.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    known = known.join(first, ["doc_id", "same"], "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask")).join(marks, "doc_id", "left")
    no = F.lit(False)
    known = known.select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "mask")
    return known.unionByName(rows.where("doc_id IS NULL").select("part", no.alias("good"), no.alias("toxic"), "mask"))


def sign_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``sums``: for each w the sum of (-1) ** bits(mask & w) over the rows of the keys."""
    sign = lambda w: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(w)) % 2)
    return rows.groupBy(*keys).agg(F.array(*(F.sum(sign(w)).cast("long") for w in range(CELLS))).alias("sums"))


def _butterfly(values: Column, bit: int) -> Column:
    at = lambda i: F.element_at(values, (i + 1).cast("int"))
    places = F.array(*map(F.lit, range(CELLS)))
    return F.transform(places, lambda i: F.when(i.bitwiseAND(bit) == 0, at(i) + at(i + bit)).otherwise(at(i - bit) - at(i)))


def inverted(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and ``cells``, from ``sums``; a stage of the transform for each projection, so that plans stay small."""
    for i in range(len(FILTERS)):
        sums = sums.select(*keys, _butterfly(F.col("sums"), 1 << i).alias("sums"))
    return sums.select(*keys, F.transform("sums", lambda x: F.shiftright(x, len(FILTERS))).alias("cells"))


def evaluate(found: DataFrame) -> DataFrame:
    """Every order and step, from ``part`` and the arrays all, good and toxic of the documents of each mask."""
    bits = F.create_map(*(F.lit(x) for i, name in enumerate(FILTERS) for x in (name, 1 << i)))
    bit_of = lambda name: F.element_at(bits, name)
    steps = found.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "name")).where("name <> ''")
    earlier = F.aggregate(F.slice(F.split("filter_order", ""), 1, F.col("place")), F.lit(0), lambda m, name: m.bitwiseOR(bit_of(name)))
    steps = steps.select("part", "filter_order", (F.col("place") + 1).cast("int").alias("step"), bit_of(F.col("name")).alias("own"), earlier.alias("before"), "all", "good", "toxic")
    own, before, places = F.col("own"), F.col("before"), F.array(*map(F.lit, range(CELLS)))

    def count(column: str, where, weight=None) -> Column:
        """Documents of the cells that ``where`` (of a mask) takes."""
        n = lambda m: F.element_at(F.col(column), (m + 1).cast("int")) * (F.lit(1) if weight is None else weight(m))
        return F.aggregate(places, F.lit(0).cast("long"), lambda total, m: total + F.when(where(m), n(m)).otherwise(0))

    fails, gone = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    shares = F.array(F.lit(0), *(F.lit(len(ORDERS) // k) for k in range(1, len(FILTERS) + 1)))
    return steps.select(
        "part", "filter_order", "step",
        count("all", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        count("all", removed).alias("removed"),
        count("all", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.element_at("all", (own + 1).cast("int")).alias("unique_fails"),
        count("good", removed).alias("good_lost"),
        count("toxic", removed).alias("toxic_lost"),
        count("all", fails, lambda m: F.element_at(shares, (F.bit_count(m) + 1).cast("int"))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, source; labels: doc_id, quality, toxic. A null text is an empty one and a null source the part
    ''. A document fails E if a row of a smaller id has its text, so equal rows of one id all pass where that id is the
    first; rows without an id compare with none, pass E and have no labels. Where labels repeat an id, one row with
    quality 1 makes it good, one with toxic 1 toxic. Texts of any length are taken whole. Without documents there are
    no parts and no rows; other columns, whatever their names, play no part.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    keys = ["part", "good", "toxic"]
    found = scratch.table(inverted(sign_sums(masked(docs, labels, scratch), keys), keys), "cells")
    total = lambda which: F.array(*(F.sum(F.when(which, F.element_at("cells", m + 1)).otherwise(0)).cast("long") for m in range(CELLS)))
    return evaluate(found.groupBy("part").agg(total(F.lit(True)).alias("all"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic")))
