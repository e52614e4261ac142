"""Language identification of mixed-language text.

A word's script (by code-point range) leaves only the languages that were written in it in training. Hashed byte
n-grams of the word give a score for each of those. Viterbi over the words, with a penalty for each switch, labels
spans; a document's language is the one that labels most of its letters.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.llm.common import LETTER, TABLE_ROWS, U64, byte_rows, mix, pieces, prepare, ragged, span_hash, sum_tables, table_batches, task, word_spans

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
#: Nats that a change of language between two words must gain.
SWITCH = 10.0
SMOOTH = 0.5
#: A language is a candidate for a script that at least this share of its training letters is written in.
SCRIPT_SHARE = 0.005
UNDETERMINED = "und"
#: Scripts by first code point of a range; the last entry that is not greater holds. Fixed values of Unicode's blocks.
SCRIPTS = ((0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Southeast Asian"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Other"))
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_AT = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


def _lead_script() -> np.ndarray:
    """Script by the first two bytes of a UTF-8 sequence (16-bit index); enough to tell the ranges above."""
    first, second = np.divmod(np.arange(1 << 16), 256)
    two = (first & 31) << 6 | (second & 63)
    three = (first & 15) << 12 | (second & 63) << 6
    point = np.where(first < 0x80, first, np.where(first < 0xE0, two, np.where(first < 0xF0, three, 0x20000)))
    return SCRIPT_AT[np.searchsorted(SCRIPT_STARTS, point, side="right") - 1].astype(np.int8)


LEAD_SCRIPT = _lead_script()


def distinct_words(rows: list[bytes]):
    """Row, letter bytes and index of the distinct word of each word; then where each distinct word stands in the bytes."""
    data, starts, ends, row = word_spans(rows, ~LETTER)
    _, first, which = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
    return data, row, ends - starts, which, starts[first], ends[first]


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and bucket of each n-gram of the words between blanks, A-Z folded; and the script of each word."""
    size = ends - starts + 2
    text = np.full(int(size.sum()), 32, np.uint32)
    begin = np.cumsum(size) - size
    inner = ragged(begin + 1, size - 2)
    raw = data[ragged(starts, ends - starts)]
    text[inner] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    word = np.repeat(np.arange(len(size)), size)
    words, buckets = [], []
    for n in GRAMS:
        code = text[: len(text) - n + 1].astype(U64)
        for k in range(1, n):
            code = code << U64(8) | text[k : len(text) - n + 1 + k]
        whole = word[: len(text) - n + 1] == word[n - 1 :] if len(text) >= n else np.zeros(0, bool)
        words.append(word[: len(whole)][whole])
        with np.errstate(over="ignore"):
            buckets.append((mix(code[whole] + U64(n) * U64(0x9E3779B97F4A7C15)) & U64(BUCKETS - 1)).astype(np.int64))
    lead = text[begin + 1].astype(np.int64) << 8 | text[np.minimum(begin + 2, len(text) - 1)].astype(np.int64)
    return np.concatenate(words), np.concatenate(buckets), LEAD_SCRIPT[lead]


@task
def _learn(batches):
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, rows = batch.column(0).to_pylist(), byte_rows(batch.column(1))
        for lang in sorted(set(langs)):
            own = [r for r, x in zip(rows, langs) if x == lang]
            table = tables.setdefault(lang, np.zeros(BUCKETS + 64, np.int64))
            for first, last in pieces(own):
                data, _, letters, which, starts, ends = distinct_words(own[first:last])
                if not len(which):
                    continue
                words, buckets, script = word_features(data, starts, ends)
                times = np.bincount(which, minlength=len(starts))
                table[:BUCKETS] += np.bincount(buckets, times[words], BUCKETS).astype(np.int64)
                table[BUCKETS:] += np.bincount(script, times * (ends - starts), 64).astype(np.int64)
    yield from table_batches(tables)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict:
    """Hashed n-gram log probabilities and scripts of each non-null label, from all rows given."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    tables = sum_tables(rows.mapInArrow(_learn, TABLE_ROWS), BUCKETS + 64)
    langs = sorted(tables)
    counts = np.array([tables[x][:BUCKETS] for x in langs], np.float64).reshape(-1, BUCKETS)
    letters = np.array([tables[x][BUCKETS:] for x in langs], np.float64).reshape(-1, 64)
    shares = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return {"langs": langs, "log": np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).T.astype(np.float32).copy(), "scripts": (shares >= SCRIPT_SHARE).T}


def viterbi(scores: list[np.ndarray], penalty: float, cells: int = 1 << 24) -> list[np.ndarray]:
    """The best labelling of each word-by-language score matrix, many documents at a time."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    todo = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    while todo:
        longest, n = scores[todo[0]].shape
        group, todo = todo[: max(1, cells // (longest * n))], todo[max(1, cells // (longest * n)) :]
        padded = np.zeros((longest, len(group), n), np.float32)
        for k, i in enumerate(group):
            padded[: len(scores[i]), k] = scores[i]
        stays, bests = np.ones((longest, len(group), n), bool), np.zeros((longest, len(group)), np.int16)
        value = padded[0].copy()
        for t in range(1, longest):
            bests[t] = value.argmax(axis=1)
            jump = value.max(axis=1, keepdims=True) - np.float32(penalty)
            stays[t] = value >= jump
            value = np.maximum(value, jump) + padded[t]
        label, rows, path = value.argmax(axis=1), np.arange(len(group)), np.zeros((longest, len(group)), np.int64)
        for t in range(longest - 1, -1, -1):
            path[t] = label
            label = np.where(stays[t, rows, label], label, bests[t])
        for k, i in enumerate(group):
            out[i] = path[: len(scores[i]), k]
    return out


def label_words(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all words. first: where each document's words begin, and the end.

    A document stays in its best single language if no stretch of words gains more than one penalty elsewhere (its
    best other languages against that one): no path with a switch can then win. Only the others need the recursion.
    """
    labels = np.zeros(len(scores), np.int64)
    mixed = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if a == b:
            continue
        own = scores[a:b]
        top = int(own.sum(axis=0).argmax())
        labels[a:b] = top
        if own.shape[1] > 1:
            gain = np.delete(own, top, axis=1).max(axis=1) - own[:, top] if own.shape[1] > 2 else own[:, 1 - top] - own[:, top]
            total = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
            if (total - np.minimum.accumulate(total)).max() > penalty:
                mixed.append((a, b))
    for (a, b), path in zip(mixed, viterbi([scores[a:b] for a, b in mixed], penalty)):
        labels[a:b] = path
    return labels


@task
def _predict(batches, model):
    model = model.value
    langs, log, scripts = model["langs"], model["log"], model["scripts"]
    for batch in batches:
        rows = byte_rows(batch.column(2))
        for first, last in pieces(rows, 4 << 20):
            held = rows[first:last]
            kept, owner, weights = [], [], []
            for a, b in pieces(held) if langs else []:
                data, row, letters, which, starts, ends = distinct_words(held[a:b])
                if len(which):
                    words, buckets, script = word_features(data, starts, ends)
                    at = np.flatnonzero(np.concatenate(([True], words[1:] < words[:-1])))  # n-grams of one length follow each other
                    score = np.zeros((len(starts), len(langs)), np.float32)
                    for k in range(len(at)):
                        run = slice(at[k], at[k + 1] if k + 1 < len(at) else None)
                        here = np.flatnonzero(np.concatenate(([True], words[run][1:] != words[run][:-1])))
                        score[words[run][here]] += np.add.reduceat(log[buckets[run]], here, axis=0)
                    allowed = scripts[script]
                    score[~allowed & allowed.any(axis=1, keepdims=True)] -= 1e4
                    kept.append(score[which])
                    owner.append(row + a)
                    weights.append(letters)
            scores = np.concatenate(kept) if kept else np.zeros((0, max(1, len(langs))), np.float32)
            owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
            weights = np.concatenate(weights) if weights else np.zeros(0, np.int64)
            bounds = np.searchsorted(owner, np.arange(len(held) + 1))
            labels = label_words(scores, bounds, SWITCH)
            share = np.bincount(owner * scores.shape[1] + labels, weights, len(held) * scores.shape[1]).reshape(len(held), -1)
            total, top = share.sum(axis=1), share.argmax(axis=1)
            picked, sure, spans = [], [], []
            for i, text in enumerate(held):
                own = labels[bounds[i] : bounds[i + 1]]
                empty = not langs or not total[i] or not (text.upper() != text.lower() or any(map(str.isalpha, text.decode("utf-8", "replace"))))
                picked.append(UNDETERMINED if empty else langs[top[i]])
                sure.append(0.0 if empty else share[i, top[i]] / total[i])
                turns = [] if empty else [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist()]
                spans.append([{"first_word": t, "n_words": n - t, "lang": langs[own[t]]} for t, n in zip(turns, [*turns[1:], len(own)])])
            span = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
            carried = [batch.column(k).slice(first, last - first) for k in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], pa.array(picked, pa.string()), pa.array(sure, pa.float64()), pa.array(spans, span), *carried], names=["doc_id", "held_out", "lang_pred", "score", "spans", *(["row"] if carried else [])])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 4, held: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the letters), spans (first_word, n_words, lang) of every row.

    Learns from rows whose crc32(id as text) mod ``fold`` is not ``held`` and whose text and label are not null; the
    label, source and id are no inputs of a prediction. ``und`` with score 0 and no span if the text is null, empty
    or has no letter, or if there was nothing to learn from. A row with a null id is predicted, not learned from.
    Repeated rows each get a row; an empty table gives none. Columns in ``carry`` come along as a struct ``row``.
    """
    spark = docs.sparkSession
    prepare(spark)
    remainder = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(fold))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder == held, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(remainder != held, F.lit(False)).alias("learned"), *([F.struct(*carry).alias("row")] if carry else []))
    model = spark.sparkContext.broadcast(train(rows.where("learned")))
    schema = StructType.fromDDL("doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<first_word:int,n_words:int,lang:string>>")
    rows = rows.drop("lang", "learned")
    return rows.mapInArrow(partial(_predict, model=model), StructType([*schema, *rows.schema[3:]]))
