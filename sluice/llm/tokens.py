"""Whole-text encoding with the ``tokenizers`` library, each distinct segment encoded once.

Both public BPE vocabularies split text before merging, and no split part crosses from a non-blank into a blank or
from a letter into a punctuation mark. So a text's ids are those of its segments, one after another; the library
encodes a segment when a worker first meets it.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array

import numpy as np
import pandas as pd
import public_tokenizers

from sluice.llm.common import BYTE_EXACT, SPACE, ragged, span_hash

#: Segments that a Python worker keeps; those it meets first are the common ones.
MEMO_SEGMENTS = 800_000
#: Blank to the library but not ASCII blank; a text that holds one is encoded in one go.
OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_OPEN: dict = {}
_code = np.arange(256)
#: Classes of bytes. LATER: second bytes of the Latin-1 letters, whose first byte is 0xC3; the two others are signs.
BLANK, LETTER, MARK, LATER, LEAD = 1, 2, 4, 8, 16
_letter = (_code >= 65) & (_code <= 90) | (_code >= 97) & (_code <= 122)
_mark = (_code > 32) & (_code < 127) & ~_letter & ~((_code >= 48) & (_code <= 57))
_later = (_code >= 0x80) & (_code < 0xC0) & (_code != 0x97) & (_code != 0xB7)
CLASS = (BLANK * SPACE + LETTER * _letter + MARK * _mark + LATER * _later + LEAD * (_code == 0xC3)).astype(np.uint8)
#: Equal hashes of shorter segments are taken as equal strings (64 bits); longer ones are compared.
COMPARED = 64


def segment_spans(data: np.ndarray, row_starts: np.ndarray, blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each segment. ``blanks``: leading blanks are part of it (byte-level BPE), else left out."""
    kind = CLASS[data]
    cut = np.zeros(len(data), bool)
    here, last = kind[1:], kind[:-1]
    letter = last & LETTER != 0
    letter[1:] |= (last[1:] & LATER != 0) & (last[:-1] & LEAD != 0)
    turn = (here & BLANK) > (last & BLANK) if blanks else (here ^ last) & BLANK != 0
    np.logical_or(turn, letter & (here & MARK != 0), out=cut[1:])
    cut[row_starts[row_starts < len(data)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    if blanks:
        return starts, ends
    word = kind[starts] & BLANK == 0
    return starts[word], ends[word]


class Encoder:
    """Ids of whole texts. ``blanks``: whether blanks are part of segments (byte-level BPE)."""

    def __init__(self, vocabulary: str, blanks: bool, most: int = MEMO_SEGMENTS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tool = Tokenizer.from_file(vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary))
        self.tool.encode_special_tokens = True
        self.blanks, self.most, self.memo = blanks, most, {}

    @classmethod
    def get(cls, vocabulary: str, blanks: bool, most: int = MEMO_SEGMENTS) -> Encoder:
        """The worker's own encoder, kept between tasks. most: segments that it remembers."""
        key = vocabulary, blanks, most
        if key not in _OPEN:
            _OPEN[key] = cls(*key)
        return _OPEN[key]

    def _whole(self, row: bytes) -> np.ndarray:
        return np.array(self.tool.encode(row.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")

    def _learn(self, segments: list[bytes]) -> dict[bytes, bytes]:
        new = {}
        for at in range(0, len(segments), 50_000):
            part = segments[at : at + 50_000]
            for s, e in zip(part, self.tool.encode_batch_fast([s.decode("utf-8", "replace") for s in part], add_special_tokens=False)):
                new[s] = array("I", e.ids).tobytes()
        if (room := self.most - len(self.memo)) > 0:
            self.memo.update(itertools.islice(new.items(), room))
        return new

    @staticmethod
    def _equal(data: np.ndarray, starts: np.ndarray, size: np.ndarray, own: np.ndarray) -> bool:
        """Whether each segment is the same string as the one that stands for it."""
        long = np.flatnonzero((size > COMPARED) & (own != np.arange(len(own))))
        return np.array_equal(size, size[own]) and all(np.array_equal(data[starts[i] : starts[i] + size[i]], data[starts[own[i]] : starts[own[i]] + size[i]]) for i in long.tolist())

    def encode(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text as unsigned 32-bit integers."""
        odd = {i for i, r in enumerate(rows) if self.blanks and not r.isascii() and OTHER_BLANKS.search(r.decode("utf-8", "replace")) or b"\x1c" in r or b"\x1d" in r or b"\x1e" in r or b"\x1f" in r}
        plain = [b"" if i in odd else r if self.blanks else r.lower() for i, r in enumerate(rows)]
        joined = b"".join(plain)
        data = np.frombuffer(joined, np.uint8)
        row_ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        starts, ends = segment_spans(data, np.concatenate(([0], row_ends[:-1])), self.blanks) if len(data) else (np.zeros(0, np.int64),) * 2
        which, distinct = pd.factorize(span_hash(data, starts, ends, BYTE_EXACT)) if len(starts) else (np.zeros(0, np.int64), np.zeros(0))
        first = np.zeros(len(distinct), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        if not self._equal(data, starts, ends - starts, first[which]):
            return [self._whole(r) for r in rows]  # two segments share a hash
        keys = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        coded = list(map(self.memo.get, keys))
        new = self._learn([k for k, c in zip(keys, coded) if c is None])
        coded = [c if c is not None else new[k] for k, c in zip(keys, coded)]
        flat = np.frombuffer(b"".join(coded), "<u4")
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begins = np.cumsum(lengths) - lengths
        stream = flat[ragged(begins[which], lengths[which])]
        cuts = np.concatenate(([0], np.cumsum(lengths[which])))[np.searchsorted(starts, row_ends)]
        return [self._whole(rows[i]) if i in odd else part for i, part in enumerate(np.split(stream, cuts[:-1]))]


def forget() -> None:
    """Drop this process's encoders and what they remember."""
    _OPEN.clear()
