"""Content-addressed store of token-id streams.

A rolling hash cuts each document's id stream into chunks, so shared passages give equal chunks wherever they stand.
``objects`` holds each distinct chunk once under its SHA-256; ``recipes`` lists, in ascending document order, the
chunks of each document with a root over id, length and chunks; ``manifest`` has, for each recipe file, the number of
documents and tokens and the Merkle root of its documents in order, and the same for the whole store. Reading checks
every chunk against its name, every document against its root, every recipe file against the manifest, and the
manifest against the root of the store: what is missing, repeated, swapped, moved or altered raises.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import U64, Scratch, byte_rows, column_batch, mix, pieces, powers, prepare, task
from sluice.llm.tokens import Encoder

VOCABULARY = "byte_bpe_50k.json"
#: Tokens seen by the rolling hash; a cut where its low bits are 0; bounds of a chunk in tokens.
WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 64, 4096
#: Chunks in more than one of so many places of all recipes are joined by broadcast: that many of them at most.
COMMON = 10_000
#: Digests that a writing task remembers; a chunk it meets again after that is dropped by the exchange instead.
SEEN = 500_000
END = np.zeros(1, "<u4")
TOKEN_HASH = mix((np.arange(1 << 16, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
PART = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
RECIPE = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("local_start", pa.int64()), ("digests", pa.binary()), ("root", pa.binary())])
RECIPE_ROWS = "part int, doc_id long, n_tokens long, local_start long, digests binary, root binary"
MANIFEST = pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])
MANIFEST_ROWS = "part int, n_docs long, n_tokens long, root binary"


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 nodes; an odd node moves up unchanged."""
    level = leaves or [b""]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def document_root(doc_id: int | None, n_tokens: int, digests: list[bytes]) -> bytes:
    """Root of a document: its id, its length and its chunks in order."""
    name = b"\0" if doc_id is None else b"\1" + doc_id.to_bytes(8, "big", signed=True)
    return hashlib.sha256(b"\2" + name + n_tokens.to_bytes(8, "big") + merkle(digests)).digest()


def rolling_cuts(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW ids asks for a cut."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    up, down = powers(len(ids) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(ids) + 1, U64)
        np.cumsum(TOKEN_HASH[ids & (len(TOKEN_HASH) - 1)] * up[:-1], out=sums[1:], dtype=U64)
        rolled = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(ids) - WINDOW + 1])
    return np.flatnonzero(rolled & U64((1 << CUT_BITS) - 1) == 0) + WINDOW


def chunk_ends(first: int, last: int, cuts: np.ndarray) -> list[int]:
    """Ends of the chunks of the stream at [first, last), given where the hash asks for cuts."""
    ends, at = [], first
    for cut in [*cuts[np.searchsorted(cuts, first + WINDOW) : np.searchsorted(cuts, last)].tolist(), last]:
        while cut - at > MOST:
            at += MOST
            ends.append(at)
        if cut == last or cut - at >= LEAST:
            if cut > at:
                ends.append(cut)
            at = cut
    return ends


@task
def _chunk(batches, vocabulary: str, width: str):
    encoder, task, serial, seen = Encoder.get(vocabulary, True), TaskContext.get().partitionId(), 0, set()
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), byte_rows(batch.column(1))
        for first, last in pieces(rows, 4 << 20):
            coded = encoder.encode(rows[first:last])
            stream = np.concatenate([x for c in coded for x in (c, END)])
            cuts, narrow, step, at = rolling_cuts(stream), memoryview(stream.astype(width).tobytes()), np.dtype(width).itemsize, 0
            out: list[tuple] = []
            for doc, c in zip(ids[first:last], coded):
                end, digests = at + len(c) + 1, []
                n, begin = end - at, at
                for stop in chunk_ends(at, end, cuts):
                    payload = bytes(narrow[begin * step : stop * step])
                    digests.append(hashlib.sha256(payload).digest())
                    begin = stop
                    if digests[-1] not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digests[-1])
                        out.append((0, digests[-1], None, None, payload))
                out.append((1, task.to_bytes(4, "big") + serial.to_bytes(8, "big"), doc, n, b"".join(digests)))
                serial, at = serial + 1, end
            for i in range(0, len(out), 4000):
                yield column_batch(PART, **dict(zip(PART.names, zip(*out[i : i + 4000]))))


@task
def _once(batches):
    """Equal chunks meet in one partition; the first is kept."""
    seen: set[bytes] = set()
    for batch in batches:
        keys, kinds = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        keep = []
        for key, kind in zip(keys, kinds):
            keep.append(kind == 1 or key not in seen)
            if kind == 0:
                seen.add(key)
        yield batch.filter(pa.array(keep))


def split_digests(packed: bytes) -> list[bytes]:
    return [packed[i : i + 32] for i in range(0, len(packed), 32)]


@task
def _number(batches):
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.asarray(batch.column(1), np.int64)
        ends = start + np.cumsum(n)
        docs, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        roots = [document_root(i, size, split_digests(d)) for i, size, d in zip(docs, n.tolist(), lists)]
        yield column_batch(RECIPE, part=np.full(len(n), part, np.int32), doc_id=batch.column(0), n_tokens=n, local_start=ends - n, digests=lists, root=roots)
        start = int(ends[-1]) if len(n) else start


@task
def _manifest(batches):
    """What the recipes say of each of their files: documents, tokens, and the root of the documents in order."""
    roots: dict[int, list[bytes]] = {}
    totals: dict[int, int] = {}
    for batch in batches:
        for part, start, doc, n, digests in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if start != totals.get(part, 0):
                raise ValueError(f"recipe file {part} has a gap or an overlap at token {start}")
            roots.setdefault(part, []).append(document_root(doc, n, split_digests(digests)))
            totals[part] = start + n
    keys = list(roots)
    columns = ([*keys], [len(roots[k]) for k in keys], [totals[k] for k in keys], [merkle(roots[k]) for k in keys])
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, MANIFEST.types)], schema=MANIFEST)


def manifest_of(spark: SparkSession, path: str) -> list[tuple[int, int, int, bytes]]:
    """(part, documents, tokens, root) of the recipe files as they are now, ascending; as many rows as there are files."""
    rows = spark.read.schema(RECIPE_ROWS).parquet(f"{path}/recipes").select("part", "local_start", "doc_id", "n_tokens", "digests")
    rows = rows.repartition("part").sortWithinPartitions("part", "local_start").mapInArrow(_manifest, MANIFEST_ROWS)
    return sorted((r["part"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in rows.collect())


def store_row(parts: list[tuple[int, int, int, bytes]]) -> tuple[int, int, int, bytes]:
    """The manifest's row of the whole store, as part -1."""
    return (-1, sum(p[1] for p in parts), sum(p[2] for p in parts), merkle([root for *_, root in parts]))


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> str:
    """Encode every whole text, append id 0, and write objects, recipes and manifest under ``path``; returns the store's root.

    Null and empty texts are the end id alone; equal rows have a recipe each and share chunks; an empty table gives an
    empty store; a null id sorts first.
    """
    spark = docs.sparkSession
    prepare(spark)
    width = "<u2" if Encoder.get(vocabulary, True).tool.get_vocab_size() <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "kind int, key binary, doc_id long, n_tokens long, payload binary"
    parts = rows.mapInArrow(partial(_chunk, vocabulary=vocabulary, width=width), kinds)
    parts.repartition("key").mapInArrow(_once, kinds).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    recipes = spark.read.schema(kinds).parquet(f"{path}/objects").where("kind = 1")
    ordered = recipes.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "n_tokens", "payload")
    ordered.mapInArrow(_number, RECIPE_ROWS).write.parquet(f"{path}/recipes")
    parts = manifest_of(spark, path)
    spark.createDataFrame([*parts, store_row(parts)], MANIFEST_ROWS).coalesce(1).write.parquet(f"{path}/manifest")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/objects/kind=1")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return store_row(parts)[3].hex()


def _mul(a: int, b: int) -> int:
    """Product modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1
    return out


@lru_cache(1 << 16)
def _shift(bits: int) -> int:
    """x**bits modulo the CRC-32 polynomial."""
    out, square = 1 << 31, 1 << 30
    while bits:
        if bits & 1:
            out = _mul(square, out)
        square, bits = _mul(square, square), bits >> 1
    return out


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two strings one after the other."""
    return _mul(_shift(8 * second_bytes), first) ^ second


@task
def _check(batches, width: str):
    for batch in batches:
        keys, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sizes, sums = [], []
        for key, payload in zip(keys, payloads):
            if hashlib.sha256(payload).digest() != key:
                raise ValueError(f"chunk {key.hex()} does not match its name")
            wide = np.frombuffer(payload, width).astype("<u4")
            sizes.append(len(wide))
            sums.append(zlib.crc32(wide.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["key", "n", "crc"])


@task
def _rebuild(batches):
    for batch in batches:
        part, start, doc, n_said, root, chunks = (batch.column(i).to_pylist() for i in range(6))
        totals, sums = [], []
        for d, said, want, found in zip(doc, n_said, root, chunks):
            crc = total = 0
            leaves = []
            for c in sorted(found, key=lambda c: c["pos"]):
                if c["n"] < 0:
                    raise ValueError(f"document {d} does not match its recipe: chunk {c['key'].hex()} is missing")
                leaves.append(c["key"])
                crc = crc_join(crc, c["crc"], 4 * c["n"])
                total += c["n"]
            if total != said or document_root(d, total, leaves) != want:
                raise ValueError(f"document {d} does not match its recipe")
            totals.append(total)
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(totals, pa.int64()), pa.array(sums, pa.int64())], names=["part", "local_start", "doc_id", "n_tokens", "ids_crc32"])


def verify_manifest(spark: SparkSession, path: str, root: str | None = None) -> list[tuple[int, int, int, bytes]]:
    """The manifest's rows of the recipe files; ValueError unless recipes, manifest and store root (if given) agree."""
    written = sorted((r["part"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in spark.read.schema(MANIFEST_ROWS).parquet(f"{path}/manifest").collect())
    if not written or written[0] != store_row(written[1:]):
        raise ValueError("the manifest does not match the root of the store")
    if root is not None and written[0][3].hex() != root:
        raise ValueError("the store is not the one asked for")
    found = manifest_of(spark, path)
    if found != written[1:]:
        bad = sorted({p[0] for p in set(found) ^ set(written[1:])})
        raise ValueError(f"recipe files {bad} do not match the manifest")
    return found


def read_store(spark: SparkSession, path: str, vocabulary: str = VOCABULARY, root: str | None = None) -> DataFrame:
    """One row for each document of the store: doc_id, start, n_tokens, ids_crc32, all from the files, verified.

    Raises where the recipes differ from the manifest, the store's root from ``root`` or a chunk from its name; the
    rows raise where a document is not what its root says.
    """
    prepare(spark)
    parts = verify_manifest(spark, path, root)
    width = "<u2" if Encoder.get(vocabulary, True).tool.get_vocab_size() <= 1 << 16 else "<u4"
    objects = spark.read.schema("key binary, payload binary, kind int").parquet(f"{path}/objects").where("kind = 0").select("key", "payload")
    scratch = Scratch(spark, "read")
    chunks = scratch.table(objects.mapInArrow(partial(_check, width=width), "key binary, n long, crc long"), "chunks")
    recipes = spark.read.schema(RECIPE_ROWS).parquet(f"{path}/recipes")
    digests = F.expr("transform(sequence(0, length(digests) div 32 - 1), i -> substring(digests, i * 32 + 1, 32))")
    steps = recipes.select("part", "local_start", "doc_id", "n_tokens", "root", F.posexplode(digests).alias("pos", "key"))
    # A chunk that stands in very many documents would meet all of them in one task.
    places = recipes.agg(F.sum(F.expr("length(digests) div 32"))).first()[0] or 0
    common = scratch.table(steps.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") * COMMON > places).select("key"), "common")
    known = F.broadcast(common.join(chunks.join(F.broadcast(common), "key", "left_semi"), "key", "left"))
    joined = steps.join(known, "key").unionByName(steps.join(F.broadcast(common), "key", "left_anti").join(chunks, "key", "left"))
    document = ["part", "local_start", "doc_id", "n_tokens", "root"]
    chunk = F.struct("pos", "key", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"))
    found = joined.groupBy(*document).agg(F.collect_list(chunk).alias("chunks"))
    rebuilt = found.select("part", "local_start", "doc_id", "n_tokens", "root", "chunks").mapInArrow(_rebuild, "part int, local_start long, doc_id long, n_tokens long, ids_crc32 long")
    starts = np.cumsum([0, *(n for _, _, n, _ in parts)]).tolist()
    before = spark.createDataFrame([(p[0], at) for p, at in zip(parts, starts)], "part int, before long")
    return rebuilt.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def store_path(spark: SparkSession) -> str:
    return Scratch(spark, "store").path("ids")


def read_ids(spark: SparkSession, path: str, doc_id: int, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids of one document, for inspection."""
    width = "<u2" if Encoder.get(vocabulary, True).tool.get_vocab_size() <= 1 << 16 else "<u4"
    digests = spark.read.parquet(f"{path}/recipes").where(F.col("doc_id") == doc_id).first()["digests"]
    names = [digests[i : i + 32] for i in range(0, len(digests), 32)]
    objects = spark.read.schema("key binary, payload binary, kind int").parquet(f"{path}/objects").where("kind = 0")
    have = {bytes(r["key"]): bytes(r["payload"]) for r in objects.where(F.col("key").isin([bytearray(x) for x in names])).collect()}
    return [i for name in names for i in np.frombuffer(have[bytes(name)], width).tolist()]
