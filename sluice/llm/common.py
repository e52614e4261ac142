"""Shared pieces of the training-data operators: scratch tables, hashing of text buffers, packing of arrays."""

from __future__ import annotations

import ctypes
import functools
import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from sluice.plans.scratch import Scratch, shared_dir, ship  # noqa: F401

U64 = np.uint64
#: Text bytes hashed at a time; bounds the numpy temporaries of a Python worker (about 40 bytes each).
PIECE_BYTES = 1 << 20


#: Rows and bytes of a batch between Spark and Python, at most; texts can be very long.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, and lower Arrow batches to what they hold comfortably."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Modules whose tasks use the remembered segments of ``tokens``.
ENCODING = ("sluice.llm.packing", "sluice.llm.store")


def task(f):
    """A partition function whose worker gives its freed memory back when the task ends; workers are kept by Spark.

    A worker that turns from encoding to another operator forgets its segments first.
    """

    @functools.wraps(f)
    def run(*args, **kwargs):
        if f.__module__ not in ENCODING and "sluice.llm.tokens" in sys.modules:
            sys.modules["sluice.llm.tokens"].forget()
        try:
            yield from f(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return run


def byte_rows(column: pa.Array) -> list[bytes]:
    """The rows of a string column as UTF-8 bytes; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def pieces(rows: list, size: int = PIECE_BYTES, weigh=len):
    """Consecutive slices (first, last) of about ``size`` bytes; a longer row stands alone."""
    first, total = 0, 0
    for i, row in enumerate(rows):
        if total and total + weigh(row) > size:
            yield first, i
            first, total = i, 0
        total += weigh(row)
    if first < len(rows):
        yield first, len(rows)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

_byte = np.arange(256, dtype=U64)
_fold = np.arange(256)
_fold[65:91] += 32
#: A pseudo-random number for each byte, A-Z as a-z.
BYTE_FOLDED = mix((_byte + U64(1)) * _BASE)[_fold]
BYTE_EXACT = mix((_byte + U64(1)) * _BASE)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS["up"]) < n:
        size = -(-n // PIECE_BYTES) * PIECE_BYTES + 4096
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(rows: list[bytes], blanks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the rows, then start, end and row of each word ``[^\\x20\\x09-\\x0D]+``."""
    data = np.frombuffer(b"".join(rows), np.uint8)
    ends_of = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, none
    blank = blanks[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends_of] = True
    cut[0] = True
    word = ~blank
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return data, starts, ends, np.searchsorted(ends_of, starts, side="right")


def span_blocks(starts: np.ndarray, ends: np.ndarray):
    """Consecutive slices (first, last) of spans that cover about PIECE_BYTES; a longer span stands alone."""
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE_BYTES, side="right")))
        yield first, last
        first = last


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_FOLDED) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span stands. Spans ascend and don't overlap."""
    out = np.empty(len(starts), U64)
    for a, b in span_blocks(starts, ends):
        base = starts[a]
        own = data[base : ends[b - 1]]
        s, e = starts[a:b] - base, ends[a:b] - base
        up, down = powers(len(own) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(own) + 1, U64)
            np.cumsum(table[own] * up[:-1], out=sums[1:], dtype=U64)
            out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
    return out


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given counts."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(total)


def column_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _tables(key: str, table: np.ndarray, block: int):
    for at in range(0, len(table), block):
        part = table[at : at + block]
        if part.any():
            yield f"{key}/{at // block}", zstandard.compress(pack(part.astype("<i8")), 1)


def table_batches(tables: dict[str, np.ndarray], block: int = 1024):
    """Count tables of one task as rows (key/block, compressed counts); blocks without counts are left out."""
    rows = [x for key, table in tables.items() for x in _tables(key, table, block)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["key", "counts"])


@task
def _add(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zstandard.decompress(blob), "<i8")
            if key in sums:
                sums[key] += part
            else:
                sums[key] = part.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sums), pa.array([zstandard.compress(pack(x), 1) for x in sums.values()])], names=["key", "counts"])


TABLE_ROWS = "key string, counts binary"


def sum_tables(parts: DataFrame, size: int, block: int = 1024) -> dict[str, np.ndarray]:
    """The tables of all tasks added up. Their size is fixed by the model, not by the input, so the driver holds them."""
    out: dict[str, np.ndarray] = {}
    for row in parts.repartition("key").mapInArrow(_add, TABLE_ROWS).toLocalIterator():
        key, _, at = row["key"].rpartition("/")
        part = np.frombuffer(zstandard.decompress(row["counts"]), "<i8")
        out.setdefault(key, np.zeros(size, np.int64))[int(at) * block : int(at) * block + len(part)] = part
    return out
