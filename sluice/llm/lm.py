"""Language-model scores by deleted interpolation.

Bigram, unigram and uniform estimates are mixed by weights that depend on how often the context was seen; the weights
are learned by expectation-maximisation on counts from which the scored token itself is deleted. Counts are exact and
cover all training text. Documents are dealt into chunks; a chunk asks for the counts of its distinct n-grams in one
sorted block for each range of keys, and gets the counts of all training text back in the same order. So the corpus is
never exploded into a row for each token, and no vocabulary is held in one place. Many chunks ask in two steps: groups
of chunks first merge what they ask of a wide range, so blocks stay large however many chunks there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import U64, Scratch, byte_rows, mix, pack, pieces, prepare, span_hash, word_spans

#: Text of a chunk, in bytes.
CHUNK_BYTES = 6 << 20
#: So many chunks ask every range of keys themselves; more are grouped, by this many or by their square root.
DIRECT = 1024
END = U64(0x5851F42D4C957F2D)
#: Classes of contexts by the logarithm of their count; cells of the statistics are quarter octaves.
CONTEXTS, CELL = 24, 4
ROUNDS = 40
REQUEST = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, so that their empty high bytes vanish."""
    steps = np.diff(keys, prepend=U64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def _small(counts: np.ndarray) -> bytes:
    return zstandard.compress(pack(counts.astype("<u8")), 1)


def ngrams(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, unigram key (odd) and bigram key (even) of every token; each row ends in an end token, its first context."""
    words, owner = [], []
    for a, b in pieces(rows):
        data, starts, ends, row = word_spans(rows[a:b])
        words.append(span_hash(data, starts, ends) if len(row) else np.zeros(0, U64))
        owner.append(row + a)
    owner = np.concatenate([*owner, np.arange(len(rows))]) if rows else np.zeros(0, np.int64)
    word = np.concatenate([*words, np.full(len(rows), END, U64)]) if rows else np.zeros(0, U64)
    order = np.argsort(owner, kind="stable")
    owner, word = owner[order], word[order]
    before = np.roll(word, 1)
    before[np.flatnonzero(np.diff(owner, prepend=-1))] = END
    with np.errstate(over="ignore"):
        pair = mix(before * U64(0x9E3779B97F4A7C15) + word * U64(0xC2B2AE3D27D4EB4F)) & ~U64(1)
    return owner, word | U64(1), pair


def _blocks(asker: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Sorted keys and their counts, a row for each of so many ranges of keys that holds any."""
    bucket = ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = [(bucket[a], asker, _planes(keys[a:b]), _small(counts[a:b])) for a, b in zip(at, [*at[1:], len(keys)])]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), REQUEST)], schema=REQUEST)


def _request(table: pa.Table, buckets: int) -> pa.Table:
    chunk, rows = table.column("chunk")[0].as_py(), byte_rows(table.column("text").combine_chunks())
    learned = np.where(np.asarray(table.column("learned")), np.asarray(table.column("copies")), 0)
    owner, word, pair = ngrams(rows)
    keys, which = np.unique(np.concatenate([word, pair]), return_inverse=True)
    counts = np.bincount(which, np.tile(learned[owner], 2), len(keys)).astype(np.uint64)
    return _blocks(chunk, keys, counts, buckets)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct keys of all requests, their summed counts, the keys of each request and where they are among all."""
    parts = [_keys(b) for b in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(zstandard.decompress(b), "<u8") for b in table.column("counts").to_pylist()])
    keys, which = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, np.bincount(which, counts, len(keys)).astype(np.int64), parts, which


def _merge(table: pa.Table, ranges: int, buckets: int) -> pa.Table:
    """What a group of chunks asks of one wide range, as requests to the narrow ranges in it."""
    asker = table.column("team")[0].as_py() * ranges + table.column("bucket")[0].as_py()
    keys, counts, _, _ = _merged(table)
    return _blocks(asker, keys, counts.astype(np.uint64), buckets)


def _deal(requests: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers that a group got for one wide range, dealt to its chunks."""
    _, _, parts, which = _merged(requests)
    blobs = [b for _, b in sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()))]
    total = np.concatenate([np.frombuffer(zstandard.decompress(b), "<u8") for b in blobs])
    ends = np.cumsum([len(p) for p in parts])
    counts = [_small(total[which[e - len(p) : e]]) for p, e in zip(parts, ends)]
    return pa.table([requests.column("chunk"), requests.column("bucket"), pa.array(counts, pa.binary())], names=["chunk", "bucket", "counts"])


def _answer(table: pa.Table) -> pa.Table:
    chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    keys, total, parts, which = _merged(table)
    single = (keys & U64(1)).astype(bool)
    n, v = int(total[single].sum()), int((total[single] > 0).sum())
    ends = np.cumsum([len(p) for p in parts])
    answers = [_small(total[which[e - len(p) : e]]) for p, e in zip(parts, ends)]
    first = [i == 0 for i in range(len(parts))]
    return pa.Table.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(parts), pa.int64()), pa.array(answers, pa.binary()), pa.array([n * f for f in first], pa.int64()), pa.array([v * f for f in first], pa.int64())], schema=REPLY)


def _counted(docs: pa.Table, replies: pa.Table):
    """Owner of each token, and the training counts of the token, of its context and of both together."""
    owner, word, pair = ngrams(byte_rows(docs.column("text").combine_chunks()))
    keys, which = np.unique(np.concatenate([word, pair]), return_inverse=True)
    blobs = [b for _, b in sorted(zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist()))]
    counts = np.concatenate([np.frombuffer(zstandard.decompress(b), "<u8") for b in blobs]).astype(np.int64)
    if len(counts) != len(keys):
        raise ValueError("a chunk and its counts do not match")
    one, two = counts[which[: len(word)]], counts[which[len(word) :]]
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    context = np.roll(one, 1)
    context[start] = counts[np.searchsorted(keys, END | U64(1))] if len(start) else 0
    return owner, one, context, two


def context_class(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))) + 1, CONTEXTS - 1), 0).astype(np.int64)


def _cells(docs: pa.Table, replies: pa.Table, n: int) -> pa.Table:
    """Tokens by context class and the levels of their bigram and unigram estimates, the token itself deleted.

    A cell has the number of its tokens and the sums of their estimates, which are not rounded.
    """
    owner, one, context, two = _counted(docs, replies)
    times = np.asarray(docs.column("copies"), np.int64)[owner]
    one, context, two = one - 1, context - 1, two - 1
    pair, single = two / np.maximum(context, 1), one / max(n - 1, 1)
    level = lambda p: np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-30)) * CELL), -999).astype(np.int64)
    # One number for the three (levels are -999 to 0, in steps of 2048), which sorts many times faster than rows.
    cell, which = np.unique((context_class(context) * 2048 + level(pair) + 1000) * 2048 + level(single) + 1000, return_inverse=True)
    add = lambda x: np.bincount(which.ravel(), x * times, len(cell))
    sums = {"times": add(np.ones(len(times))).astype(np.int64), "pairs": add(pair), "singles": add(single)}
    return pa.table({"context": cell >> 22, "pair": (cell >> 11) % 2048 - 1000, "single": cell % 2048 - 1000, **sums})


def expectation_maximisation(context: np.ndarray, estimates: np.ndarray, times: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each context class; classes without tokens keep the starting ones.

    A context that was never seen has no bigram estimate, so its class shares that weight among the others.
    """
    start = np.array([0.4, 0.4, 0.2])
    weights = np.tile(start, (CONTEXTS, 1))
    for _ in range(rounds):
        joint = weights[context] * estimates
        share = joint / joint.sum(axis=1, keepdims=True) * times[:, None]
        sums = np.stack([np.bincount(context, share[:, k], CONTEXTS) for k in range(3)], axis=1)
        total = sums.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, (sums + start) / (total + 1), start)  # one made-up token keeps every weight over 0
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def _score(docs: pa.Table, replies: pa.Table, n: int, v: int, weights: np.ndarray) -> pa.Table:
    owner, one, context, two = _counted(docs, replies)
    size = docs.num_rows
    w = weights[context_class(context)]
    p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(n, 1) + w[:, 2] / (v + 1)
    base = np.log10((one + 0.1) / (n + 0.1 * (v + 1)))
    add = lambda x: np.bincount(owner, x, size)
    arrays = [docs.column("doc_id"), docs.column("held_out"), np.bincount(owner, minlength=size), add(one > 0).astype(np.int64), np.full(size, n), add(base), add(np.log10(p))]
    return pa.table([*arrays, docs.column("copies")], names=[*(f.split()[0] for f in SCORED.split(", ")), "copies"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10, held: int = 0, tuning: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) of every row.

    Learns from rows whose crc32(id as text) mod ``fold`` is not ``held``; all of these give the deleted counts that the
    weights are learned from, or only those with remainder ``tuning`` if it is given and some row has it. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z folded. Null and empty texts are the end token alone. A row with a null id is
    scored, not learned from. Repeated rows count each and get a row each; an empty table gives no rows. Other columns
    play no part. A document, however long, is scored by one task.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = rows.groupBy(F.xxhash64("doc_id", "text").alias("hash"), "doc_id").agg(F.count("*").alias("copies"), F.sum(F.octet_length("text") + 1).alias("size"))
    found = sizes.agg(F.max("copies").alias("copies"), F.sum("size").alias("size"), F.count_if(remainder_of("doc_id", fold) == F.lit(tuning).cast("long")).alias("tuning")).first()
    if (found["copies"] or 0) > 1:  # repeated rows are scored once, or one task would gather them
        rows = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    left = remainder_of("doc_id", fold)
    tunes = left == tuning if found["tuning"] else left != held
    flags = {"held_out": left == held, "learned": left != held, "tuning": tunes}
    rows = rows.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    chunks = max(1, -(-(found["size"] or 0) // CHUNK_BYTES))
    # The rows that tune have chunks of their own; the others are few where all that is learned from tunes.
    apart = max(1, chunks // fold if found["tuning"] else chunks)
    place = F.xxhash64("doc_id", "text")
    chunk = F.when(F.col("tuning"), -1 - F.pmod(place, F.lit(apart))).otherwise(F.pmod(place, F.lit(chunks)))
    rows = rows.withColumn("chunk", chunk)
    replies, n, v = replies_of(rows.select("chunk", "learned", "copies", "text"), chunks, scratch)
    tuned = rows.where("tuning").select("chunk", "copies", "text").groupBy("chunk").cogroup(replies.where("chunk < 0").groupBy("chunk"))
    cells = tuned.applyInArrow(lambda own, counts: _cells(own, counts, n), "context long, pair long, single long, times long, pairs double, singles double")
    sums = [F.sum(c).alias(c) for c in ("times", "pairs", "singles")]
    cells = cells.groupBy("context", "pair", "single").agg(*sums).collect()  # CONTEXTS times the squared number of levels, at most
    context, times = (np.array([r[k] for r in cells], np.int64) for k in ("context", "times"))
    pair, single = (np.array([r[k] / r["times"] for r in cells]) for k in ("pairs", "singles"))
    weights = expectation_maximisation(context, np.stack([pair, single, np.full(len(pair), 1 / (v + 1))], axis=1), times)
    dealt = rows.select("chunk", "doc_id", "held_out", "copies", "text").groupBy("chunk").cogroup(replies.groupBy("chunk"))
    scored = dealt.applyInArrow(lambda own, counts: _score(own, counts, n, v, weights), SCORED + ", copies long")
    if (found["copies"] or 0) > 1:
        some = F.expr("explode(sequence(0, (copies - 1) div 10000))")
        scored = scored.withColumn("some", some).withColumn("one", F.expr("explode(sequence(1, least(10000, copies - some * 10000)))"))
    return scored.select(*(f.split()[0] for f in SCORED.split(", ")))


def remainder_of(id_col: str, fold: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(fold))


def replies_of(rows: DataFrame, chunks: int, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """chunk, bucket, counts: the training counts of each chunk's keys; the number of tokens and of distinct ones."""
    asked, answered = "bucket long, chunk long, keys binary, counts binary", "chunk long, bucket long, counts binary, n long, v long"
    ranges = chunks if chunks <= DIRECT else max(DIRECT, int(np.ceil(np.sqrt(chunks))))
    requests = rows.groupBy("chunk").applyInArrow(lambda own: _request(own, ranges), asked)
    if chunks > DIRECT:
        teams, buckets = -(-chunks // ranges), ranges * -(-chunks // ranges)
        requests = scratch.table(requests.withColumn("team", F.pmod("chunk", F.lit(teams))), "requests")
        merged = requests.groupBy("team", "bucket").applyInArrow(lambda own: _merge(own, ranges, buckets), asked)
    else:
        merged = requests
    replies = scratch.table(merged.groupBy("bucket").applyInArrow(lambda own: _answer(own), answered), "replies")
    sizes = replies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    replies = replies.select("chunk", "bucket", "counts")
    if chunks > DIRECT:
        back = replies.select(F.expr(f"chunk div {ranges}").alias("team"), (F.col("chunk") % ranges).alias("wide"), "bucket", "counts")
        both = requests.groupBy("team", "bucket").cogroup(back.groupBy("team", "wide"))
        replies = scratch.table(both.applyInArrow(lambda own, counts: _deal(own, counts), "chunk long, bucket long, counts binary"), "dealt")
    return replies, sizes["n"], sizes["v"]
