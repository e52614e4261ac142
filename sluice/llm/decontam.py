"""Benchmark decontamination by the q-gram lemma.

Items are cut into overlapping windows, each with a budget of edits. A text within k edits of a window of length m
shares at least m + 1 - q - k * q of its q-grams with it, on diagonals that differ by at most k. So shared q-grams are
counted in diagonal bands 2 * (k + 1) wide that overlap by half; only regions that reach the bound are aligned, and
the alignment is confined to their band.

Windows begin at fixed places of an item. So that it doesn't matter where a copied passage begins, the same lemma is
also asked of every place of an item: hits of a band are sorted by their place in the item, and each stretch in which
enough of them lie within one passage's length is aligned for all starts it allows.

Long runs of a short period (rules, tables, one byte over and over) are searched in a shortened form that holds the
same stretches, and hits are expanded in blocks of bounded size. A benchmark too large for one index is searched in
two steps: a scan of the texts by a filter of all its q-grams, then the few texts that are near by each index.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import BYTE_EXACT, SPACE, U64, Scratch, byte_rows, mix, pieces, powers, prepare, ragged, task

Q, WINDOW, STRIDE = 10, 100, 50
#: One edit for so many bytes of a window.
PER_EDIT = 12
#: Bytes and edits of the passages looked for at every place of an item; the lemma asks for the same 11 q-grams of each.
PASSAGES = ((60, 4), (100, 8))
#: Starts aligned at a time.
STARTS = 4096
#: Items of an index that workers hold, in bytes (it takes up to 100 times that); items of a filter, of 64 MB.
ITEM_BYTES, FILTER_BYTES = 1 << 20, 64 << 20
FILTER_BITS, WIDE_BITS = 22, 29
#: Bytes within which the hits of a window or passage lie; hits expanded at a time; periods whose runs are shortened.
REACH, POSTINGS, PERIODS = 256, 1 << 20, 16
FOUND = "doc_id long, item_id long, windows int, item_windows int, start long, end long, edits int"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACE] = 32


def normal(row: bytes) -> bytes:
    """A-Z folded and each run of blanks one space."""
    return b" ".join(row.lower().split())


def normal_all(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The normal form of all rows between zero bytes, and where each begins."""
    parts = [normal(r).replace(b"\0", b"\1") for r in rows]
    data = np.frombuffer(b"\0".join([b"", *parts, b""]), np.uint8)
    return data, np.cumsum([1, *(len(p) + 1 for p in parts)])[:-1]


def gram_hash(data: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    if len(data) < Q:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_EXACT[data] * up[:-1], out=sums[1:], dtype=U64)
        return mix((sums[Q:] - sums[:-Q]) * down[: len(data) - Q + 1])


def budget(size: int) -> int:
    """Edits allowed in a window, so few that the lemma still asks for a shared q-gram."""
    return max(0, min(size // PER_EDIT, (size - Q) // Q))


def runs_shortened(data: np.ndarray) -> np.ndarray | None:
    """Which bytes stay when runs of a period up to PERIODS lose whole periods from their middle; None if all stay.

    What stays of a run is longer than REACH and a period, so the stretches of up to REACH bytes are the same before
    and after, and what begins first or ends last keeps its place.
    """
    keep, probe = 2 * REACH, REACH // 2
    origin = None
    for p in range(1, PERIODS + 1):
        at = np.arange(0, len(data) - probe - p, probe)
        for t in range(0, probe, 5):  # a long run covers a whole probe
            at = at[(data[at + t] == data[at + t + p]) & (data[at + t] != 0)]
        if not len(at):
            continue
        same = np.concatenate(([False], (data[p:] == data[:-p]) & (data[p:] != 0) & (data[:-p] != 0), [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        first, size = edge[::2], edge[1::2] - edge[::2] + p
        long = size > keep + p
        if not long.any():
            continue
        gone = np.zeros(len(data) + 1, np.int64)
        cut = (size[long] - keep) // p * p
        begin = first[long] + keep // 2
        end_before = 0
        for b, n in zip(begin.tolist(), cut.tolist()):  # runs of one period may touch, their middles don't
            b = max(b, end_before)
            gone[b] += 1
            gone[b + n] -= 1
            end_before = b + n
        stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        origin = stay if origin is None else origin[stay]
        data = data[stay]
    return origin


class Index:
    """Distinct windows of the items by the hashes of their q-grams. Items shorter than Q bytes are no evidence."""

    def __init__(self, items: list[tuple[int, bytes]]):
        known: dict[bytes, int] = {}
        texts: dict[bytes, int] = {}
        self.holders, self.names, self.per_item = [], [], {}  # (item, text) of each window, items of each text
        for item, text in items:
            text = normal(text)
            if len(text) < Q:
                continue
            starts = list(range(0, max(1, len(text) - WINDOW + 1), STRIDE))
            if len(text) > WINDOW and starts[-1] + WINDOW < len(text):
                starts.append(len(text) - WINDOW)
            t = texts.setdefault(text, len(texts))
            self.names += [[]] * (len(texts) - len(self.names))
            self.names[t] = [*self.names[t], item]
            self.per_item[item] = self.per_item.get(item, 0) + len(starts)
            for s in starts:
                w = known.setdefault(text[s : s + WINDOW], len(known))
                if w == len(self.holders):
                    self.holders.append([])
                self.holders[w].append((item, t))
        self.windows = [np.frombuffer(w, np.uint8) for w in known]
        self.texts = [shortened(np.frombuffer(t, np.uint8)) for t in texts]
        flat, self.window, self.offset = grams_of(self.windows)
        self.keys, self.first, self.count = np.unique(flat, return_index=True, return_counts=True)
        self.code = np.repeat(np.arange(len(self.keys)), self.count) * len(self.windows) + self.window
        # The same q-grams by their place in the whole item: windows cover an item, so all of them are keys.
        flat, self.text, self.place = grams_of(self.texts)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.whole = np.concatenate([np.zeros(0, np.uint8), *self.texts])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.text_first = np.searchsorted(flat, self.keys, side="left")
        self.text_count = np.searchsorted(flat, self.keys, side="right") - self.text_first
        self.text_code = np.repeat(np.arange(len(self.keys)), self.text_count) * len(self.texts) + self.text
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> U64(64 - FILTER_BITS)] = True
        self.budget = np.array([budget(len(w)) for w in self.windows], np.int64)
        self.bound = np.array([len(w) + 1 - Q - k * Q for w, k in zip(self.windows, self.budget)], np.int64)


def shortened(text: np.ndarray) -> np.ndarray:
    origin = runs_shortened(text)
    return text if origin is None else text[origin]


def grams_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all q-grams, ascending, and the text and place of each; of equal ones, by text and place."""
    hashes = [gram_hash(t) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    order = np.argsort(flat, kind="stable")
    return flat[order], np.repeat(np.arange(len(sizes)), sizes)[order], ragged(np.zeros(len(sizes), np.int64), sizes)[order]


def expanded(key: np.ndarray, first: np.ndarray, count: np.ndarray, code: np.ndarray, owners: int):
    """Hit and posting of each pair of a text's q-gram with one of the index, for some windows or items at a time.

    Parts hold some POSTINGS pairs; one owner's postings of REACH bytes of text are the least a part can hold.
    """
    parts = min(owners, -(-int(count[key].sum()) // (2 * POSTINGS)))
    if parts <= 1:
        yield np.repeat(np.arange(len(key)), count[key]), ragged(first[key], count[key])
        return
    bounds = np.linspace(0, owners, parts + 1).astype(np.int64)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        a, b = (np.searchsorted(code, key * owners + x) for x in (low, high))
        yield np.repeat(np.arange(len(key)), b - a), ragged(a, b - a)


def hit_blocks(at: np.ndarray, row: np.ndarray, weight: np.ndarray):
    """Slices (first, last) of the hits of some rows, or of a part of one row with many; parts overlap by REACH bytes."""
    total = np.concatenate(([0], np.cumsum(weight)))
    ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row)).tolist()
    first = 0
    for k, end in enumerate(ends):
        begin = ends[k - 1] if k else 0
        if total[end] - total[begin] > POSTINGS:  # a row by itself
            if first < begin:
                yield first, begin
            a = begin
            while True:
                b = max(int(np.searchsorted(total, total[a] + POSTINGS, side="right")) - 1, int(np.searchsorted(at[:end], at[a] + 2 * REACH)))
                b = min(b, end)
                yield a, b
                if b == end:
                    break
                a = int(np.searchsorted(at[:end], at[b] - REACH))
            first = end
        elif total[end] - total[first] > POSTINGS:
            yield first, begin
            first = begin
    if first < len(row):
        yield first, len(row)


def aligned(window: np.ndarray, region: np.ndarray, low: int, high: int, limit: int) -> tuple[int, int] | None:
    """Fewest edits of the window against any part of the region, and where that ends, on diagonals low to high."""
    diagonals = np.arange(low, high + 1)
    steps = np.arange(len(diagonals))
    row = np.where((diagonals >= 0) & (diagonals <= len(region)), 0, limit + 1)
    for i, c in enumerate(window):
        at = diagonals + i  # the region's byte that this diagonal pairs with the window's i-th
        inside = (at >= 0) & (at < len(region))
        same = np.where(inside, region[np.clip(at, 0, max(len(region) - 1, 0))] == c, False) if len(region) else np.zeros(len(at), bool)
        step = np.where(inside, row + ~same, limit + 1)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)  # the window's byte is missing
        row = np.minimum.accumulate(step - steps) + steps  # bytes of the region are extra
        row[(at + 1 < 0) | (at + 1 > len(region))] = limit + 1
        if row.min() > limit:
            return None
    best = int(row.argmin())
    return int(row[best]), int(diagonals[best]) + len(window)


def shared(data: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Where q-grams of the items stand, and which keys of the index they are."""
    hashes = gram_hash(data)
    at = np.flatnonzero(index.filter[hashes >> U64(64 - FILTER_BITS)]) if len(index.keys) else np.zeros(0, np.int64)
    key = np.minimum(np.searchsorted(index.keys, hashes[at]), max(len(index.keys) - 1, 0))
    real = index.keys[key] == hashes[at] if len(at) else np.zeros(0, bool)
    return at[real], key[real]


def search(data: np.ndarray, starts: np.ndarray, index: Index, hits: tuple[np.ndarray, np.ndarray] | None = None, out: dict | None = None) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Start, end and edits of every (row, window) found; positions in the row's normal form. ``out`` is added to."""
    at, key = shared(data, index) if hits is None else hits
    out = {} if out is None else out
    ends = np.append(starts[1:] - 1, len(data) - 1)
    for hit, post in expanded(key, index.first, index.count, index.code, len(index.windows)):
        if not len(post):
            continue
        window = index.window[post]
        diagonal = at[hit] - index.offset[post]
        row = np.searchsorted(starts, at[hit], side="right") - 1
        step = index.budget[window] + 1
        band = np.concatenate([diagonal // step, diagonal // step - 1])  # band b: diagonals b * step to (b + 2) * step - 1
        cell = cells(np.tile(row, 2), np.tile(window, 2), band, len(index.windows))
        _, first, count = np.unique(cell, return_index=True, return_counts=True)
        cell = np.stack([np.tile(row, 2)[first], np.tile(window, 2)[first], band[first]], axis=1)
        for r, w, b in cell[count >= index.bound[cell[:, 1]]].tolist():
            text, k, base = index.windows[w], int(index.budget[w]), int(starts[r])
            if (r, w) in out and not out[r, w][2]:
                continue
            low, high = b * (k + 1), (b + 2) * (k + 1) - 1
            exact = verbatim(data, text, max(low, base), min(high + len(text) + 1, int(ends[r])))
            if exact is not None:
                out[r, w] = (exact - base, exact - base + len(text), 0)
                continue
            begin, end = max(base, low - k), min(int(ends[r]), high + len(text) + k)
            found = aligned(text, data[begin:end], low - begin, high - begin, k)
            if found and found[0] <= k and ((r, w) not in out or found[0] < out[r, w][2]):
                stop = begin + found[1] - base
                out[r, w] = (max(0, stop - len(text)), stop, found[0])
    return out


def cells(row: np.ndarray, which: np.ndarray, band: np.ndarray, number: int) -> np.ndarray:
    """One number for each row, window or item (of so many) and band, in that order."""
    low = int(band.min())
    return (row.astype(np.int64) * number + which) * (int(band.max()) - low + 1) + (band - low)


def passages(data: np.ndarray, starts: np.ndarray, index: Index, hits: tuple[np.ndarray, np.ndarray], spans: dict[tuple[int, int], tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(row, text of the index, start, end, edits) of passages that begin anywhere in an item.

    ``spans`` holds, for a row and text, the part that is found already; passages inside it add nothing and are passed
    over, and it grows with those found.
    """
    out: list[tuple[int, int, int, int, int]] = []
    for hit, post in expanded(hits[1], index.text_first, index.text_count, index.text_code, len(index.texts)):
        if len(post):
            out += passages_at(data, starts, index, hits[0][hit], index.text[post], index.place[post], spans)
    return out


def passages_at(data: np.ndarray, starts: np.ndarray, index: Index, at: np.ndarray, text: np.ndarray, place: np.ndarray, spans: dict) -> list[tuple[int, int, int, int, int]]:
    """``passages`` from the places of the row's q-grams, and their texts and places in the index."""
    diagonal = at - place
    row = np.searchsorted(starts, at, side="right") - 1
    ends, out, runs = np.append(starts[1:] - 1, len(data) - 1), [], {}

    def note(r: int, t: int, start: int, end: int, edits: int) -> None:
        a, b = spans.get((r, t), (start, end))
        spans[r, t] = (min(a, start), max(b, end))
        out.append((r, t, start, end, edits))

    # Unchanged passages: q-grams one after the other on one diagonal.
    size = min(p for p, _ in PASSAGES)
    same = cells(row, text, diagonal, len(index.texts))
    order = np.lexsort((place, same))
    broken = np.flatnonzero((np.diff(same[order]) != 0) | (np.diff(place[order]) != 1))
    first, last = np.append(0, broken + 1), np.append(broken, len(order) - 1)
    long = last - first >= size - Q
    for i, j in zip(order[first[long]].tolist(), order[last[long]].tolist()):
        base = int(starts[row[i]])
        note(int(row[i]), int(text[i]), int(at[i]) - base, int(at[j]) + Q - base, 0)
        runs.setdefault((int(row[i]), int(text[i])), []).append((int(diagonal[i]), int(place[i]), int(place[j]) + Q))

    for size, most in PASSAGES:
        own = np.flatnonzero(index.lengths[text] >= size)
        step, more = most + 1, size - Q - most * Q  # the last of as many hits as the lemma asks for is this far on
        if 2 * len(own) <= more:
            continue
        band = diagonal[own] // step
        both, band = np.tile(own, 2), np.concatenate([band, band - 1])
        cell = cells(row[both], text[both], band, len(index.texts))
        order = np.lexsort((place[both], cell))
        cell, where, band, both = cell[order], place[both][order], band[order], both[order]
        dense = np.flatnonzero((cell[more:] == cell[: len(cell) - more]) & (where[more:] - where[: len(where) - more] <= size - Q))
        if not len(dense):
            continue
        low, high, cell = where[dense + more] - (size - Q), where[dense], cell[dense]  # starts of passages that hold them
        cut = np.flatnonzero((np.diff(cell) != 0) | (low[1:] > high[:-1] + 1))
        found = []
        for a, b in zip(np.append(0, cut + 1).tolist(), np.append(cut, len(dense) - 1).tolist()):
            i = int(both[dense[a]])
            r, t, shift = int(row[i]), int(text[i]), int(band[dense[a]]) * step
            base, end = int(starts[r]), int(ends[r])
            p = np.arange(max(0, int(low[a])), min(int(high[b]), int(index.lengths[t]) - size) + 1)
            for d, x, y in runs.get((r, t), ()):
                if shift <= d < shift + 2 * step:
                    p = p[(p < x) | (p + size > y)]
            if (r, t) in spans:
                s, e = spans[r, t]
                p = p[(np.maximum(p + shift - base, 0) < s) | (np.minimum(p + shift + 2 * step - 1 + size, end) - base > e)]
            if len(p):
                found.append((p, *(np.full(len(p), x) for x in (r, t, base, end, shift))))
        if found:
            p, r, t, base, end, shift = map(np.concatenate, zip(*found))
            for part in range(0, len(p), STARTS):
                own = slice(part, part + STARTS)
                which, stop, edits = anywhere(index.whole, p[own] + index.begins[t[own]], size, data, p[own] + shift[own], base[own], end[own], 2 * step, most)
                for k, x, n in zip((which + part).tolist(), stop.tolist(), edits.tolist()):
                    x -= int(base[k])
                    note(int(r[k]), int(t[k]), max(0, x - size), x, n)
    return out


def anywhere(text: np.ndarray, begin: np.ndarray, size: int, data: np.ndarray, first: np.ndarray, base: np.ndarray, end: np.ndarray, width: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the passages that begin at these places of the items are within the limit, where they end, and their edits.

    The same recurrence as ``aligned`` for many passages side by side, on so many diagonals from ``first`` on, between
    ``base`` and ``end`` of the data.
    """
    steps = np.arange(width)
    which, at, base, end = np.arange(len(begin)), first[:, None] + steps, base[:, None], end[:, None]
    row = np.where((at >= base) & (at <= end), 0, limit + 1)
    for i in range(size):
        inside = (at >= base) & (at < end)
        same = data[np.clip(at, 0, len(data) - 1)] == text[begin + i][:, None]
        step = np.where(inside, row + ~same, limit + 1)
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)  # the passage's byte is missing
        row = np.minimum.accumulate(step - steps, axis=1) + steps  # bytes of the data are extra
        at = at + 1
        row[(at < base) | (at > end)] = limit + 1
        alive = row.min(axis=1) <= limit
        if not alive.all():
            which, row, at, begin, base, end = (x[alive] for x in (which, row, at, begin, base, end))
            if not len(which):
                break
    best = row.argmin(axis=1)
    each = np.arange(len(which))
    return which, at[each, best], row[each, best]


def verbatim(data: np.ndarray, text: np.ndarray, begin: int, end: int) -> int | None:
    """Where the window stands unchanged between two places."""
    place = data[begin : max(begin, end)].tobytes().find(text.tobytes())
    return begin + place if place >= 0 else None


def matches(data: np.ndarray, starts: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, 1 for a window and 0 for another passage, start, end, edits) of all that is found."""
    origin, begins = runs_shortened(data), starts
    if origin is not None:
        data, starts = data[origin], np.searchsorted(origin, starts)
    at, key = shared(data, index)
    row = np.searchsorted(starts, at, side="right") - 1
    windows: dict[tuple[int, int], tuple[int, int, int]] = {}
    blocks = list(hit_blocks(at, row, index.count[key] + index.text_count[key]))
    for a, b in blocks:
        search(data, starts, index, (at[a:b], key[a:b]), windows)
    out: list[tuple[int, int, int, int, int, int]] = []
    spans: dict[tuple[int, int], tuple[int, int]] = {}
    for (r, w), (start, end, edits) in windows.items():
        for item, t in index.holders[w]:
            out.append((r, item, 1, start, end, edits))
            a, b = spans.get((r, t), (start, end))
            spans[r, t] = (min(a, start), max(b, end))
    for a, b in blocks:
        for r, t, start, end, edits in passages(data, starts, index, (at[a:b], key[a:b]), spans):
            out += [(r, item, 0, start, end, edits) for item in index.names[t]]
    if origin is not None:
        place = lambda r, x: int(origin[starts[r] + x] - begins[r])
        out = [(r, item, kind, place(r, start), place(r, max(start, end - 1)) + 1, edits) for r, item, kind, start, end, edits in out]
    return out


@task
def _find(batches, index):
    index = index.value
    names = [f.split()[0] for f in FOUND.split(", ")]
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), byte_rows(batch.column(1))
        out = []
        for a, b in pieces(rows):
            data, starts = normal_all(rows[a:b])
            by: dict[tuple[int, int], list] = {}
            for r, item, window, start, end, edits in matches(data, starts, index):
                by.setdefault((r, item), []).append((window, start, end, edits))
            out += [(ids[a + r], item, sum(y[0] for y in x), int(index.per_item[item]), min(y[1] for y in x), max(y[2] for y in x), min(y[3] for y in x)) for (r, item), x in by.items()]
        if out:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


@task
def _near(batches, near):
    """Texts with as many q-grams of the items within REACH bytes as any window asks for."""
    bits, need = near.value
    for batch in batches:
        rows, keep = byte_rows(batch.column(1)), np.zeros(batch.num_rows, bool)
        for a, b in pieces(rows):
            data, starts = normal_all(rows[a:b])
            hashes = gram_hash(data) >> U64(64 - WIDE_BITS)
            at = np.flatnonzero(bits[hashes >> U64(3)] >> (hashes & U64(7)).astype(np.uint8) & 1)
            row = np.searchsorted(starts, at, side="right") - 1
            last = np.arange(need - 1, len(at))
            close = last[(row[last] == row[last - need + 1]) & (at[last] - at[last - need + 1] <= REACH)]
            keep[a + row[close]] = True
        yield batch.filter(pa.array(keep))


def wide_filter(texts) -> tuple[np.ndarray, int]:
    """One bit for each q-gram of the items, and the fewest of them that a window must share."""
    bits, need = np.zeros(1 << WIDE_BITS - 3, np.uint8), WINDOW
    for text in texts:
        text = np.frombuffer(normal(text), np.uint8)
        if len(text) >= Q:
            m = min(len(text), WINDOW)
            need = min(need, m + 1 - Q - budget(m) * Q, *(p + 1 - Q - k * Q for p, k in PASSAGES))
            hashes = gram_hash(text) >> U64(64 - WIDE_BITS)
            np.bitwise_or.at(bits, (hashes >> U64(3)).astype(np.int64), np.uint8(1) << (hashes & U64(7)).astype(np.uint8))
    return bits, need


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, windows found and in the item, start, end (bytes of the normal form), edits: one row a pair.

    Texts are compared with A-Z folded and blanks as one space. Only documents that hold a window of an item within
    its edit budget appear, or a passage of one of PASSAGES, wherever it begins in the item; a pair with passages only
    has 0 windows. Start and end enclose all that is found, edits are the fewest. Null and empty texts and items have
    no match, nor have items under Q bytes; a null id of a document stays; repeated rows give repeated rows; items
    that repeat under other ids match each; empty tables give none. Other columns play no part.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    known = items.select(F.col(item_id_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    known = known.where("text IS NOT NULL AND item IS NOT NULL").distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= ITEM_BYTES:
        return rows.mapInArrow(partial(_find, index=index_of(known)), FOUND)
    scratch, place = Scratch(spark, "decontam"), F.xxhash64("item", "text")
    scans, found = -(-size // FILTER_BYTES), []
    for k in range(scans):
        own = known.where(F.pmod(place, F.lit(scans)) == k)
        near = spark.sparkContext.broadcast(wide_filter(r["text"].encode() for r in own.toLocalIterator()))
        texts = scratch.table(rows.mapInArrow(partial(_near, near=near), "doc_id long, text string"), f"near-{k}")
        near.destroy()
        blocks = -(-min(size, FILTER_BYTES) // ITEM_BYTES)
        for b in range(blocks):
            index = index_of(own.where(F.pmod(F.shiftright(place, 20), F.lit(blocks)) == b))
            found.append(scratch.table(texts.mapInArrow(partial(_find, index=index), FOUND), f"found/{k}-{b}"))
            index.destroy()
    return spark.read.schema(FOUND).option("recursiveFileLookup", "true").parquet(scratch.path("found"))


def index_of(items: DataFrame):
    """Broadcast index of some ITEM_BYTES of items."""
    return items.sparkSession.sparkContext.broadcast(Index(sorted((r["item"], r["text"].encode()) for r in items.toLocalIterator())))
