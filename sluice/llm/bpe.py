"""Byte-level BPE by merge ranks: encoding of whole texts and decoding, without special tokens.

A text is split by a pattern, and each part that is no token itself is merged from its bytes: always the pair of least
rank, the leftmost of equals. Pairs wait in a queue of ranks. A bucket for each rank holds positions of the linked list
of tokens; bitmaps in three levels tell which buckets hold any, so the next rank is found by three find-first-set steps
however many ranks there are. Pairs that a merge breaks stay in their bucket and are skipped when they come up. So a
part of n bytes takes n times a logarithm, also where it is millions of bytes long.
"""

from __future__ import annotations

import base64
import itertools
import os
from array import array
from functools import partial
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from sluice.llm.common import PIECE_BYTES, byte_rows, pieces, prepare, ragged, task

#: Parts that a worker remembers, and the characters of one at most.
MEMO_PARTS, MEMO_CHARS = 400_000, 64
_OPEN: dict = {}


class Bucket:
    """Positions of one rank, least first. They arrive in any order; those of before the first take are sorted then."""

    __slots__ = ("waiting", "at", "late")

    def __init__(self):
        self.waiting, self.at, self.late = array("i"), -1, []

    def add(self, position: int) -> None:
        if self.at < 0:
            self.waiting.append(position)
        else:
            heappush(self.late, position)

    def take(self) -> int:
        """-1 if there is none."""
        if self.at < 0:
            self.waiting, self.at = array("i", np.sort(np.frombuffer(self.waiting, "i4")).tobytes()), 0
        if self.late and (self.at == len(self.waiting) or self.late[0] < self.waiting[self.at]):
            return heappop(self.late)
        if self.at == len(self.waiting):
            return -1
        self.at += 1
        return self.waiting[self.at - 1]

    def empty(self) -> bool:
        return self.at == len(self.waiting) and not self.late


class RankQueue:
    """Buckets of positions by rank, and bitmaps of those that hold any."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((len(self.low) >> 6) + 1)
        self.top = 0  # wider than a word beyond 262,144 ranks
        self.buckets: dict[int, Bucket] = {}

    def _open(self, rank: int) -> Bucket:
        bucket, word = Bucket(), rank >> 6
        self.buckets[rank] = bucket
        self.low[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)
        return bucket

    def add(self, rank: int, position: int) -> None:
        (self.buckets.get(rank) or self._open(rank)).add(position)

    def fill(self, rank: int, positions: np.ndarray) -> None:
        """Many positions of a rank that has none."""
        self._open(rank).waiting.frombytes(positions.astype("i4").tobytes())

    def least(self) -> tuple[int, Bucket]:
        """The least rank that has positions, and its bucket; to be closed once it is empty."""
        first = lambda bits: (bits & -bits).bit_length() - 1
        word = first(self.top)
        word = (word << 6) + first(self.middle[word])
        rank = (word << 6) + first(self.low[word])
        return rank, self.buckets[rank]

    def close(self, rank: int) -> None:
        word, high = rank >> 6, rank >> 12
        del self.buckets[rank]
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[high] &= ~(1 << (word & 63))
            if not self.middle[high]:
                self.top &= ~(1 << high)


class BytePairs:
    """The ranks of a vocabulary, and what a worker remembers of it."""

    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary), "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.longest, self.size = max(map(len, self.ranks)), max(self.ranks.values()) + 1
        self.pattern, self.memo, self.queue = regex.compile(pattern), {}, RankQueue(self.size)
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, self.size)
        self.of_bytes = np.array([self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)], np.int32)
        self.begins, self.blob = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def get(cls, vocabulary: str, pattern: str) -> BytePairs:
        """The worker's own, kept between tasks."""
        if (vocabulary, pattern) not in _OPEN:
            _OPEN[vocabulary, pattern] = cls(vocabulary, pattern)
        return _OPEN[vocabulary, pattern]

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, 4 bytes each; parts share one queue. KeyError where a byte has no rank."""
        ranks, longest, queue, data = self.ranks, self.longest, self.queue, b"".join(parts)
        size, ends = len(data), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        after, before, rank_at = array("i", range(1, size + 1)), array("i", range(-1, size - 1)), array("i", [-1]) * size
        first = bytearray(size + 1)  # whether a part, or nothing, begins here
        for i in (0, *ends.tolist()):
            first[i] = 1
        codes = np.frombuffer(data, np.uint8)
        rank = self.of_bytes[codes[:-1].astype(np.int32) << 8 | codes[1:]]
        rank[np.frombuffer(first, np.uint8)[1:size] != 0] = -1
        near = np.flatnonzero(rank >= 0)
        near = near[np.argsort(rank[near], kind="stable")]
        np.frombuffer(rank_at, "i4")[near] = rank[near]
        starts = np.flatnonzero(np.diff(rank[near], prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(near)]):
            queue.fill(int(rank[near[a]]), near[a:b])
        get, add = ranks.get, queue.add
        while queue.top:
            own, bucket = queue.least()
            least, take = own, bucket.take
            while least == own and (i := take()) >= 0:
                if rank_at[i] != own:
                    continue  # an earlier merge took one of the two
                second = after[i]
                end = after[i] = after[second]
                rank_at[second] = rank_at[i] = -1
                if not first[end]:
                    before[end] = i
                    last = after[end]
                    new = get(data[i:last]) if last - i <= longest else None
                    if new is not None:
                        rank_at[i] = new
                        add(new, i)
                        least = min(least, new)
                if not first[i]:
                    p = before[i]
                    new = get(data[p:end]) if end - p <= longest else None
                    rank_at[p] = -1 if new is None else new
                    if new is not None:
                        add(new, p)
                        least = min(least, new)
            if bucket.empty():
                queue.close(own)
        out, i = [], 0
        for stop in ends.tolist():
            ids = array("i")
            while i < stop:
                ids.append(ranks[data[i : after[i]]])
                i = after[i]
            out.append(ids.tobytes())
        return out

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts that are not remembered; those that are short are, while there is room."""
        new = {p: p.encode("utf-8") for p in parts}
        found = {p: array("i", (self.ranks[own],)).tobytes() for p, own in new.items() if own in self.ranks}
        rest = [p for p in new if p not in found]
        for a, b in pieces(rest):
            found.update(zip(rest[a:b], self.merge([new[p] for p in rest[a:b]])))
        self.memo.update(itertools.islice(((p, ids) for p, ids in found.items() if len(p) <= MEMO_CHARS), max(0, MEMO_PARTS - len(self.memo))))
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts, of which new parts are merged together."""
        out = []
        for a, b in pieces(texts):
            split = [self.pattern.findall(t) for t in texts[a:b]]
            new = self.learn(list(set(itertools.chain.from_iterable(split)).difference(self.memo)))
            for own in split:
                out.append(np.frombuffer(b"".join([new[p] if p in new else self.memo[p] for p in own] if new else map(self.memo.__getitem__, own)), "<i4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a whole document. ValueError for an id that is none of the vocabulary's."""
        out = []
        for at in range(0, len(ids), PIECE_BYTES // 8):
            own = ids[at : at + PIECE_BYTES // 8]
            if own.min() < 0 or own.max() >= self.size or not self.lengths[own].all():
                raise ValueError("an id that the vocabulary has not")
            out.append(self.blob[ragged(self.begins[own], self.lengths[own])].tobytes())
        return b"".join(out)


@task
def _encode(batches, vocabulary: str, pattern: str):
    tool = BytePairs.get(vocabulary, pattern)
    for batch in batches:
        ids = tool.encode([row.decode("utf-8", "replace") for row in byte_rows(batch.column(1))])
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, "<i4")]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "ids"])


@task
def _decode(batches, vocabulary: str, pattern: str):
    tool = BytePairs.get(vocabulary, pattern)
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        ends, values = lists.offsets.to_numpy(), np.asarray(lists.values)
        known = lists.is_valid().to_pylist()
        texts = [tool.decode(values[a:b]) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], known)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "bytes"])


def encode_texts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row: the ids that the ``tiktoken`` library gives its whole text as ordinary text.

    vocabulary: a file of ranks, by its path or its name among the public tokenizers. A null text is an empty one and
    has no ids; rows with a null or repeated id are encoded like any other; an empty table gives none. Other columns
    play no part. Texts are taken
    whole, however long.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["doc_id"]]).add("ids", ArrayType(IntegerType()))
    return rows.mapInArrow(partial(_encode, vocabulary=vocabulary, pattern=pattern), schema)


def decode_ids(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns of ``encoded`` and ``bytes``, what its ``ids`` stand for; null where they are null.

    An id that the vocabulary has not raises. ``encoded`` must not have a column ``bytes``.
    """
    prepare(encoded.sparkSession)
    rows = encoded.withColumn("ids", F.col("ids").cast("array<int>"))
    schema = StructType([*rows.schema.fields]).add("bytes", BinaryType())
    return rows.mapInArrow(partial(_decode, vocabulary=vocabulary, pattern=pattern), schema)
