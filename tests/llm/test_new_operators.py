"""Hard negatives, filter audit and byte-level BPE against brute force, with nulls, ties, repeats and clashing names."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<bigint>, label int"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def negatives_of(rows, anchors, positives, negatives, least=30, most=90):
    clean = [(i, x, y) for i, x, y in rows if i is not None and y is not None and x is not None and None not in x]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for own in sorted({r[0] for r in clean} & set(anchors)):
        _, x, label = min((r for r in clean if r[0] == own), key=lambda r: (r[2], r[1]))
        near = sorted((-dot(x, v), i) for i, v, y in clean if y == label and i != own)[:positives]
        for score, positive in near:
            fits = sorted((-dot(x, v), i) for i, v, y in clean if y != label and least * -score <= 100 * dot(x, v) <= most * -score)[:negatives]
            out += [(own, positive, rank + 1, i, -score, -s) for rank, (s, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(7, 4, 3, 2), (1000, 1000, 16, 4)])
def test_hard_negatives(spark, monkeypatch, sizes):
    from sluice.llm import mining

    for name, n in zip(("BLOCK_ROWS", "ANCHOR_ROWS", "LEAF", "ANCHOR_LEAF"), sizes):
        monkeypatch.setattr(mining, name, n)
    rng = random.Random(sizes[0])
    rows = [(i, [rng.randint(-9, 9) + (4 if i % 3 else 0) for _ in range(6)], rng.choice([0, 0, 0, 1, 2])) for i in range(120)]
    rows += [(i, [5, 5, 5, 0, 0, 0], i % 2) for i in range(120, 170)]  # a third or so are copies: ties by id
    rows += [(170, None, 1), (171, [1, None, 2, 0, 0, 0], 1), (172, [1] * 6, None), (None, [3] * 6, 0), (173, [7, 7], 1), (174, [], 0), (10, [1] * 6, 2), (175, [3] * 6, 9)]
    vectors = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(c) for c in ("block", "slots", "signs", "deal", "tag", "low", "rank", "held")})
    anchors = {0, 10, 20, 121, 130, 173, 174, 175, 170}
    found = mining.hard_negatives(vectors, vectors.where(F.col("vec_id").isin(*anchors)), positives=3, negatives=4)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, found.collect()))
    assert got == negatives_of(rows, anchors, 3, 4) and len({r[0] for r in got}) > 3


def test_hard_negatives_of_empty_tables(spark):
    from sluice.llm.mining import hard_negatives

    empty, one = spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, [1, 2], 0)], VECTORS)
    assert hard_negatives(empty, empty).count() == hard_negatives(one, empty).count() == hard_negatives(one, one).count() == 0
    with pytest.raises(ValueError, match="exact"):
        hard_negatives(spark.createDataFrame([(1, [1 << 40], 0)], VECTORS), spark.createDataFrame([(1, [1 << 40], 0)], VECTORS))


def test_dual_trees_drop_whole_groups():
    """Two far groups: most pairs of leaves are never scored, and what is found is exact."""
    from sluice.llm import mining

    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(40, 60, (2000, 8)), rng.integers(-60, -40, (2000, 8))]).astype(float)
    labels, ids = np.arange(4000) % 2, np.arange(4000)
    a, c = mining.Tree(rows[:64], labels[:64], 8), mining.Tree(rows, labels, 50)
    slots = mining.Slots(np.arange(64), np.full(64, -mining.EXACT), np.full(64, mining.NO_ID), np.full(64, mining.EXACT), 5)
    scored = mining.dual_search(a, c, rows[:64][a.order], ids[:64][a.order], labels[:64][a.order], rows[c.order], ids[c.order], labels[c.order], slots, True)
    assert scored < len(a.begin) * len(c.begin) / 8
    for place, own in enumerate(a.order.tolist()):
        score = rows @ rows[own]
        score[(labels != labels[own]) | (ids == own)] = -np.inf
        want = np.lexsort((ids, -score))[:5]
        assert slots.ids[place].tolist() == want.tolist()


def test_intervals_hold_every_product():
    from sluice.llm.mining import centre_of, interval

    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = rng.integers(-256, 256, (20, 16)).astype(float), rng.integers(-256, 256, (30, 16)).astype(float)
        low, high = interval(centre_of(x), centre_of(y))
        assert low <= (x @ y.T).min() and (x @ y.T).max() <= high


def audit(rows, labels):
    blank = "[\x20\x09-\x0d]+"
    first, parts = {}, {}
    for i, text, _, source, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, _, source, _ in rows:
        text, part = text or "", parts.setdefault(source or "", [])
        words = [w for w in re.split(blank, text) if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        own = [x for x in labels if x[0] == i and i is not None]
        part.append(({k for k, v in fails.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part, docs in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                before, failed = set(order[: step - 1]), [d for d in docs if name in d[0]]
                removed = [d for d in failed if not d[0] & before]
                removed_by[name] += len(removed)
                lines.append((part, order, step, sum(not d[0] & (before | {name}) for d in docs), len(removed), len(failed) - len(removed), sum(d[0] == {name} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed), name))
        out += [(*x[:-1], removed_by[x[-1]]) for x in lines]
    return sorted(out)


def test_filter_audit(spark):
    from sluice.llm.audit import audit_filters

    rng = random.Random(6)
    word = lambda: rng.choice(["Alpha", "beta", "gamma", "DELTA", "x", "y%", "z"]) + str(rng.randint(0, 40))
    texts = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(20)] + ["", " \t\n", "é" * 60, "a b " * 40, "plain words only " + " ".join(f"w{i}" for i in range(60))]
    texts = [t if rng.random() < 0.6 else t.replace("%", "").lower() for t in texts]
    rows = [(i, rng.choice(texts), "en", rng.choice(["a", "a", "b", None, ""]), 0) for i in range(90)]
    rows += [(90, None, None, "b", None), (91, None, None, None, None), (None, texts[0], None, "a", 0), (None, None, None, None, None), rows[3], rows[3], (3, "another text of the same id", "en", "b", 0), (92, "w0 w1 " * 20_000, "en", "b", 0)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("part", "mask", "same", "whole", "first", "good", "toxic", "sums")})
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("x"))
    found = audit_filters(docs, marks)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = audit(rows, labels)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 600 * 3
    assert audit_filters(docs.limit(0), marks).count() == 0
    assert {r["good_lost"] for r in audit_filters(docs, marks.limit(0)).collect()} == {0}


def test_transform_is_its_own_inverse(spark):
    from sluice.llm import audit as A

    rows = spark.createDataFrame([(m,) for m in range(32) for _ in range(m * m % 7)] + [(5,)] * 1000, "mask int").withColumn("part", F.lit("p"))
    got = A.inverted(A.sign_sums(rows, ["part"]), ["part"]).first()["cells"]
    assert got == [m * m % 7 + 1000 * (m == 5) for m in range(32)]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, library):
    from sluice.llm.bpe import decode_ids, encode_texts

    rng = random.Random(9)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [pick(letters, rng.randint(0, 400)) for letters in ("ab", "the qu'sl ", "aé日😀 \n\x85", "0123456789.", "=-_ #", "\t \r\n x") for _ in range(10)]
    texts += [None, "", "<|endoftext|> is ordinary", "a" * 50_000, pick("abcdefgh", 20_000), "the whole of it " * 5_000, "\x00\x1c "]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 0), (3, texts[3], "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("ids", "bytes", "Text_2")})
    encoded = encode_texts(docs)
    assert encoded.columns == ["doc_id", "ids"]
    got = decode_ids(encoded).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(rows)
    for r, (i, text, *_) in zip(sorted(got, key=key), sorted(rows, key=key)):
        assert (r["doc_id"], r["ids"], bytes(r["bytes"])) == (i, library.encode_ordinary(text or ""), (text or "").encode())
    assert encode_texts(docs.limit(0)).count() == 0
    assert decode_ids(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first()["bytes"] is None
    with pytest.raises(Exception, match="vocabulary has not"):
        decode_ids(spark.createDataFrame([(1, [50_300])], "doc_id bigint, ids array<int>")).collect()


def test_byte_bpe_query(spark, library):
    """Digests of the query over its whole table."""
    from sluice.llm.queries import op13_byte_bpe, table

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in op13_byte_bpe(spark, sf).collect()}
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        assert got[i] == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def naive(ranks, part):
    """Merge the least pair, the leftmost of equals, until none is left."""
    parts = [bytes([b]) for b in part]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_ranks_that_are_out_of_order(tmp_path):
    """Longer tokens of lower ranks than their parts: merges open lower buckets, and many pairs go stale."""
    from sluice.llm.bpe import BytePairs

    for seed in range(20):
        rng = random.Random(seed)
        tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)}
        order = list(tokens)
        rng.shuffle(order)
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(order)))
        tool = BytePairs(str(path), ".+")
        parts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 60))) for _ in range(30)]
        parts = [p for p in parts if p not in tool.ranks]
        assert [np.frombuffer(x, "<i4").tolist() for x in tool.merge(parts)] == [naive(tool.ranks, p) for p in parts]
        assert not tool.queue.top and not any(tool.queue.low) and not tool.queue.buckets


def sentence(rng, n):
    return " ".join(rng.choice("the of and to in that with by for this which here there were have not".split()) + rng.choice(["", "a", "e", "ing"]) for _ in range(n))


def test_decontamination_without_ids(spark):
    """Rows of a null id are found by their own text, repeated ones each; items of a null id are no evidence."""
    from sluice.llm.decontam import find_contamination

    rng = random.Random(21)
    item, other, clean = sentence(rng, 30), sentence(rng, 30), sentence(rng, 60)
    docs = spark.createDataFrame([(None, f"x {item} y"), (None, f"x {item} y"), (None, clean), (None, None), (7, other), (8, f"{clean} {item}")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (None, other)], "item_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in find_contamination(docs, bench).collect()) == [(0, 1), (0, 1), (8, 1)]


def test_pipeline_stages_take_very_long_texts(spark, tmp_path):
    """A text of a megabyte goes through every stage whole, or goes by what stands at its very end."""
    import corpus_pipeline

    rng = random.Random(22)
    item = sentence(rng, 40)
    long = sentence(rng, 160_000)
    rows = [(i, sentence(rng, 60), "en", "s", 1) for i in range(30)] + [(50, f"{long} call me at +1 212 555 0100", "en", "s", 1), (51, f"{long} also {item}", "en", "s", 1), (52, sentence(rng, 150_000) + f" {item}", "en", "s", 1)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out-{k}")
        docs = spark.read.parquet(f"{folder}/out-{k}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").distinct().collect()})
    assert [s & {50, 51, 52} for s in seen] == [{50, 51, 52}, {50, 52}, {50}, {50}, {50}]
    safe = spark.read.parquet(f"{folder}/out-3").where("doc_id = 50").first()["text"]
    assert safe == f"{long} call me at [PHONE]"
    pieces = docs.where("doc_id = 50").orderBy("piece").collect()
    assert [p["length"] for p in pieces[:-1]] == [2048] * (len(pieces) - 1) and len(pieces) > 50
