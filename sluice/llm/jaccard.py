"""Exact n-gram Jaccard join with a token-group matrix.

Documents with equal shingle sets are one class. Similar classes (equal minimum hash) form groups of bounded size. The
matrix holds, for each token, the groups whose union of prefix tokens contains it; prefixes are taken in one global
order, rare tokens first, so linked documents share a prefix token. The count of matrix hits that two groups have in
common bounds the overlap of any query in one with any member of the other: a group that cannot reach the threshold is
not opened. In an opened group each query is bounded again by the whole token union, then members are compared exactly. Links are counted
and turned into spanning links where they are found.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import TABLE_ROWS, U64, Scratch, byte_rows, mix, pack, pieces, prepare, ragged, span_hash, sum_tables, table_batches, task, word_spans
from sluice.llm.components import components, forest

#: Counters of token frequency; they only set the global order, so collisions cost time, never links.
COUNTERS = 1 << 22
#: Tokens of a group's members and queries that a task compares with it at a time; larger ones are split, none is cut.
MEMBER_TOKENS, QUERIES = 200_000, 1024
#: Ids that are broadcast (some 64 MB) to leave out texts that meet no other; more of them take a join of all texts.
BROADCAST_IDS = 1_000_000
SETS = "doc_id long, n int, d1 long, d2 long, least long, prefix array<long>"
_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(rows: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; A-Z folded."""
    data, starts, ends, row = word_spans(rows)
    out = [np.zeros(0, U64)] * len(rows)
    if not len(row):
        return out
    word = span_hash(data, starts, ends)
    n = np.bincount(row, minlength=len(rows))
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(word) - size + 1), U64)
        for k in range(size):
            whole += word[k : k + len(whole)] * _STEP[k]
        whole = mix(whole + U64(size))
        for i in np.flatnonzero(n):
            a, m = first[i], n[i]
            if m >= size:
                out[i] = np.unique(whole[a : a + m - size + 1])
            else:
                out[i] = mix(np.array([sum((word[a + k] * _STEP[k] for k in range(m)), U64(0)) + U64(m)], U64))
    return out


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n tokens with any set it is linked to."""
    return -(-n * percent // 100)


@task
def _count(batches, size: int):
    table = np.zeros(COUNTERS, np.int64)
    shift = U64(64 - COUNTERS.bit_length() + 1)
    for batch in batches:
        rows = byte_rows(batch.column(0))
        for a, b in pieces(rows):
            tokens = np.concatenate(shingle_sets(rows[a:b], size) or [np.zeros(0, U64)])
            np.add.at(table, (tokens >> shift).astype(np.int64), np.int64(1))
    yield from table_batches({"": table}, 1 << 14)


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """0 for counters that chance may fill so far (Poisson, six deviations), then one more for each doubling."""
    base = counts.mean() + 6 * np.sqrt(counts.mean()) + 2
    return np.floor(np.log2(np.maximum(counts / base, 0.5)) + 1).astype(np.uint8)


def digests(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(tokens + s).sum(dtype=U64).astype(np.int64)) for s in _STEP[:2])


@task
def _sets(batches, size: int, percent: int, classes):
    shift = U64(64 - COUNTERS.bit_length() + 1)
    for batch in batches:
        ids, rows = batch.column(0), byte_rows(batch.column(1))
        for a, b in pieces(rows):
            sets = shingle_sets(rows[a:b], size)
            n, d1, d2, least, prefix = [], [], [], [], []
            for tokens in sets:
                n.append(len(tokens))
                one, two = digests(tokens)
                d1.append(one)
                d2.append(two)
                if len(tokens):
                    take = len(tokens) - int(needed(len(tokens), percent)) + 1
                    kind = classes.value[(tokens >> shift).astype(np.int64)]
                    order = np.argsort(kind, kind="stable")[:take]  # tokens are sorted already
                    prefix.append(tokens[order].astype(np.int64))
                    common = tokens[kind > 0]  # of a text that mostly repeats elsewhere, what is its own names no group
                    least.append(int(mix((common if 2 * len(common) >= len(tokens) else tokens) ^ _STEP[4]).min().astype(np.int64)))
                else:
                    prefix.append(np.zeros(0, np.int64))
                    least.append(0)
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))
            yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(least, pa.int64()), lists], names=["doc_id", "n", "d1", "d2", "least", "prefix"])


def _with_sets(batches, size: int):
    """Rows (gid, part, member, doc_id, d1, text, copies) with the whole token set; rows whose text is not of that class go."""
    for batch in batches:
        rows = byte_rows(batch.column(5))
        for a, b in pieces(rows):
            distinct = list(dict.fromkeys(rows[a:b]))
            sets = dict(zip(distinct, shingle_sets(distinct, size)))
            named = {r: digests(s)[0] for r, s in sets.items()}
            keep = np.array([named[r] == d for r, d in zip(rows[a:b], batch.column(4)[a:b].to_pylist())])
            part = batch.slice(a, b - a)
            tokens = pa.array([pack(sets[r]) if k else b"" for r, k in zip(rows[a:b], keep)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), tokens, part.column(6)], names=["gid", "part", "member", "doc_id", "tokens", "copies"]).filter(pa.array(keep))


def compare(members: list[tuple[int, np.ndarray]], queries: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links of a group: of its members with each other, and of the queries with the members."""
    sizes = np.array([len(t) for _, t in members])
    tokens, owner = np.concatenate([t for _, t in members]), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    union, first, count = np.unique(tokens, return_index=True, return_counts=True)
    links = []
    for k, (doc, own) in enumerate(members + queries):
        at = np.minimum(np.searchsorted(union, own), len(union) - 1)
        hit = at[union[at] == own]
        if len(hit) * 100 < percent * len(own):  # no member can reach the threshold
            continue
        overlap = np.bincount(owner[ragged(first[hit], count[hit])], minlength=len(members))
        linked = np.flatnonzero(100 * overlap >= percent * (sizes + len(own) - overlap))
        links += [(doc, members[j][0]) for j in linked.tolist() if j != k]
    return links


def link_counts(links: list[tuple[int, int]], queries: set[int], copies: dict[int, int], first: bool) -> dict[int, int]:
    """Documents that each class is linked with in this part of a group.

    A query comes once, so its link counts for both ends; the links of members with each other come in both directions
    and again in every part, so they count in the first part only.
    """
    out: dict[int, int] = {}
    for a, b in links:
        if a in queries:
            out[b] = out.get(b, 0) + copies[a]
        if a in queries or first:
            out[a] = out.get(a, 0) + copies[b]
    return out


def _verify(batches, percent: int):
    """Spanning links (a, b) of each part of a group, and rows (a, a, n) with the number of documents that a is linked with."""
    key, members, queries, copies, seen, found = None, [], [], {}, set(), []

    def flush():
        links = compare(members, queries, percent) if members else []
        counts = link_counts(links, {doc for doc, _ in queries}, copies, key is None or key[1] == 0)
        for x in (members, queries, copies, seen):
            x.clear()
        return [(a, b, 0) for a, b in forest(links)] + [(a, a, n) for a, n in counts.items()]

    for batch in batches:
        gids, parts, roles, docs, blobs, numbers = (batch.column(i).to_pylist() for i in range(6))
        for gid, part, member, doc, blob, number in zip(gids, parts, roles, docs, blobs, numbers):
            if (gid, part) != key:
                found += flush()
                key = (gid, part)
            if (doc, blob) in seen:  # a repeated row
                continue
            seen.add((doc, blob))
            copies[doc] = number
            (members if member else queries).append((doc, np.frombuffer(blob, U64)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found)], names=["a", "b", "n"])
            found = []
    if found := flush():
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found)], names=["a", "b", "n"])


@task
def _open(batches, size: int, percent: int):
    yield from _verify(_with_sets(batches, size), percent)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included) of every row.

    With ``count_links`` also n_links: how many other documents (distinct ids) the row's set is linked with.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z folded; a set is the distinct shingles of ``size`` words, or the whole
    sequence where there are fewer. Sets link when 100 * intersection >= percent * union. Rows without words or text
    have no shingle and link with nothing. Rows with a null id are kept, link with nothing and have a null component.
    Repeated rows are each returned; an empty table gives no rows; other columns play no part. Shingles are known by
    64-bit hashes and equal sets by their size and two 64-bit sums, so the join is exact as far as those don't collide.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = sum_tables(rows.select("text").mapInArrow(partial(_count, size=size), TABLE_ROWS), COUNTERS, 1 << 14).get("", np.zeros(COUNTERS, np.int64))
    classes = spark.sparkContext.broadcast(frequency_class(counts))
    sets = scratch.table(rows.mapInArrow(partial(_sets, size=size, percent=percent, classes=classes), SETS), "sets")

    known = sets.where("n > 0 AND doc_id IS NOT NULL")
    # Counted apart: a distinct count beside them would shuffle the prefixes twice.
    copies = known.select("n", "d1", "d2", "doc_id").distinct().groupBy("n", "d1", "d2").agg(F.count("*").alias("copies"))
    reps = known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc"), F.first("least").alias("least"), F.first("prefix").alias("prefix")).join(copies, ["n", "d1", "d2"])
    reps = scratch.table(reps, "classes")
    sets = scratch.table(sets.drop("least", "prefix"), "keys")
    scratch.drop("sets")
    # Groups of more than MEMBER_TOKENS are dealt into blocks; their list is broadcast only if its size allows.
    large = scratch.table(reps.groupBy("least").agg(F.sum("n").alias("size"), F.count("*").alias("sets")).where(f"size > {MEMBER_TOKENS} AND sets > 1").drop("sets"), "large")
    large = F.broadcast(large) if large.count() <= 100_000 else large
    block = F.coalesce(F.pmod(F.xxhash64("d1", "d2"), F.ceil(F.col("size") / MEMBER_TOKENS)), F.lit(0))
    grouped = reps.join(large, "least", "left").select("doc", "n", "d1", "copies", F.xxhash64("least", block).alias("gid"), "prefix")
    grouped = scratch.table(grouped, "grouped")
    scratch.drop("classes", "large")

    # Dealt by token once: both the aggregate and the window stay in place.
    posts = grouped.select(F.explode("prefix").alias("token"), "n", "gid").repartition("token")
    matrix = posts.groupBy("token", "gid").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = matrix.withColumn("groups", F.count("*").over(W.partitionBy("token"))).where("groups > 1").drop("groups")
    matrix = scratch.table(matrix, "matrix")
    grouped = scratch.table(grouped.drop("prefix"), "members")
    scratch.drop("grouped")
    other = matrix.toDF("token", "target", "t_low", "t_high")
    near = matrix.join(other, "token").where(f"gid > target AND 100 * high >= {percent} * t_low AND {percent} * low <= 100 * t_high")
    hits = near.groupBy("gid", "target").agg(F.count("*").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("t_low").alias("t_low"), F.max("t_high").alias("t_high"))
    # Both prefixes hold all but needed(n) - 1 tokens, so sets of a and b tokens need this many hits. It is concave:
    # over the sizes of two groups it is least in a corner, or 0 where some sizes lie at the limit of what can link.
    need = lambda a, b: F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent) - F.lit(percent) * F.greatest(a, b) / F.lit(100)
    inside = f"100 * low >= {percent} * t_high AND 100 * t_low >= {percent} * high"
    bound = F.when(F.expr(inside), F.least(*(need(a, b) for a in ("low", "high") for b in ("t_low", "t_high")))).otherwise(F.lit(0.0))
    pairs = hits.where(F.col("hits") >= bound - 1e-6).select("gid", "target")
    # The members of the smaller group are the queries.
    sizes = scratch.table(grouped.groupBy("gid").agg(F.count("*").alias("members")), "sizes")
    pairs = pairs.join(sizes, "gid").join(sizes.toDF("target", "t_members"), "target")
    turned = F.col("members") > F.col("t_members")
    pairs = scratch.table(pairs.select(F.when(turned, F.col("target")).otherwise(F.col("gid")).alias("gid"), F.when(turned, F.col("gid")).otherwise(F.col("target")).alias("target")), "pairs")
    opened = scratch.table(grouped.select("doc", "gid").join(pairs, "gid").select("doc", "target"), "opened")

    asked = opened.groupBy("target").agg(F.count("*").alias("queries")).withColumnRenamed("target", "gid")
    info = sizes.join(asked, "gid", "left")
    info = scratch.table(info.where("members > 1 OR queries IS NOT NULL").select("gid", F.greatest(F.lit(1), F.ceil(F.coalesce("queries", F.lit(0)) / QUERIES)).cast("int").alias("parts")), "info")
    members = grouped.select("doc", "d1", "copies", "gid").join(info, "gid").select("gid", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(True).alias("member"), "doc", "d1", "copies")
    queries = opened.withColumnRenamed("target", "gid").join(info, "gid").join(grouped.select("doc", "d1", "copies"), "doc")
    queries = queries.select("gid", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("part"), F.lit(False).alias("member"), "doc", "d1", "copies")
    work = scratch.table(members.unionByName(queries), "work")
    # Only texts that are compared are shuffled, while the list of their ids may be broadcast; and texts, not their sets.
    wanted = scratch.table(work.select("doc").distinct(), "wanted")
    texts = rows.withColumnRenamed("doc_id", "doc")
    if wanted.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(wanted), "doc", "left_semi")
    work = work.join(texts, "doc").select("gid", "part", "member", "doc", "d1", "text", "copies")
    links = work.repartition("gid", "part").sortWithinPartitions("gid", "part").mapInArrow(partial(_open, size=size, percent=percent), "a long, b long, n long")
    if count_links:
        links = scratch.table(links, "links")
    found = components(links, scratch)

    classes_of = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node")).join(found, "node", "left")
    if count_links:
        classes_of = classes_of.join(grouped.select(F.col("doc").alias("node"), "n", "d1", "copies"), ["node", "n", "d1"], "left")
        counted = links.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
        classes_of = classes_of.join(counted, "node", "left")
    joined = sets.select("doc_id", "n", "d1", "d2").join(classes_of, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "node", "doc_id"))
    out = [F.col("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.cast("long").alias("component_id")]
    if count_links:  # copies of the row's own set are linked with it, unless it has none or no id
        others = F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0))
        out.append(F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(others).cast("long").alias("n_links"))
    return joined.select(*out)
