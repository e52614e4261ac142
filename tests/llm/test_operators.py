"""Every operator against a brute-force version, on tables with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {"en": "the of and to in that with by for this which here there were have not", "fr": "le la les des une dans pour que qui avec sur vous nous être était même", "de": "der die das und nicht ein eine mit auf für sich auch werden über können haben"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "a", "e", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(120):
        lang = rng.choice(list(WORDS))
        out.append((i, sentence(rng, lang, rng.randint(5, 60)), lang, f"src{i % 3}", 0))
    base = sentence(rng, "en", 60).split()
    for i in range(120, 150):  # near copies
        copy = base[:]
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = "x" + str(rng.randint(0, 99))
        out.append((i, " ".join(copy).upper() if i % 5 == 0 else "\n".join(copy), "en", "src0", 0))
    out += [(150, None, "en", "s", None), (151, "", None, None, 0), (152, " \t\n", "en", "s", 3), (153, "one two", "en", "s", 7), (154, "ONE  two", "en", "s", 8), (155, "123 456 --- !!!", None, "s", 1)]
    out += [(156, sentence(rng, "fr", 30000), "fr", "s", 0), (157, "日本語のテキスト。", None, "s", 0), (158, "Ω≈ç√ é́   x", None, "s", 0), (159, "a" * 5000, None, "s", 0)]
    out += [out[3], out[3], (None, "no id at all here and more words", "en", "s", 0), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Columns with names that operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in ("n", "d1", "gid", "token", "chunk", "length", "task", "key", "kind", "pii", "target", "shard", "value", "component", "held_out", "Text_2")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (3, 60)])
def test_near_duplicates(docs, rows, size, percent, monkeypatch):
    from sluice.llm import jaccard

    monkeypatch.setattr(jaccard, "MEMBER_TOKENS", 200)  # so that groups are split
    monkeypatch.setattr(jaccard, "QUERIES", 8)
    sets = {}
    for i, text, *_ in rows:
        if i is not None:
            sets[i] = shingles(text, size)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    got = jaccard.near_duplicates(docs, size, percent).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, len(shingles(t, size)), root(i) if i is not None else None) for i, t, *_ in rows)
    assert collections.Counter(map(tuple, got)) == want


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (3, 60)])
def test_links_are_counted(docs, rows, size, percent, monkeypatch):
    from sluice.llm import jaccard

    monkeypatch.setattr(jaccard, "MEMBER_TOKENS", 200)  # groups are split, and queries dealt into several parts
    monkeypatch.setattr(jaccard, "QUERIES", 2)
    sets = {i: shingles(text, size) for i, text, *_ in rows if i is not None}
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= percent * len(a | b)
    n_links = {i: sum(i != j and linked(s, t) for j, t in sets.items()) for i, s in sets.items()}
    assert len(set(n_links.values())) > 3
    got = jaccard.near_duplicates(docs, size, percent, count_links=True)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert collections.Counter((r["doc_id"], r["n_links"]) for r in got.collect()) == collections.Counter((i, n_links.get(i, 0)) for i, *_ in rows)


def test_near_duplicates_of_an_empty_table(empty):
    from sluice.llm.jaccard import near_duplicates

    assert near_duplicates(empty).count() == 0 and near_duplicates(empty, count_links=True).count() == 0


def test_near_duplicates_long_chain(spark):
    """Components are followed along a chain of links, whatever group a document falls into."""
    from sluice.llm.jaccard import near_duplicates

    line = [f"w{i}" for i in range(400)]
    data = [(i, " ".join(line[i * 3 : i * 3 + 100])) for i in range(100)]
    got = near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"), 1, 85).collect()
    assert {r["component_id"] for r in got} == {0}


def test_components(spark):
    from sluice.llm.common import Scratch
    from sluice.llm.components import components

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50 != 49] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(80)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5), Scratch(spark, "t")).collect()))
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else True, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark, docs, rows):
    from sluice.llm.pii import BASE, find_pii, listed, of_kind, redact

    rng = random.Random(3)
    alphabet = ["a", "B", "@", ".", "..", "-", "+", "1", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "x@y.z", "256", "10.0.0.1", "010.1.1.1.1", "+1 (212) 555-0100", "+", "(", "é", "日", "😀", "\x01", "\x02", "_", "%", "\n", "a.b@c-d.e.f", "00000255.1.1.1"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    texts += ["a@b.c.@d.e", "a@b.c..x@d.e", "1.2.3.4.5.6.7.8", "1" * 100_000, ("1-" * 30_000) + "1", "a@" + "b." * 20_000 + "c", "." * 50_000, "+1" + "(" * 3000 + "5" * 8, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = find_pii(df, keep=("doc_id",)).select("doc_id", "whole_text", listed(of_kind(F.col("pii"), *BASE)).alias("base"), listed(F.col("pii")).alias("all"), redact(F.col("whole_text"), F.col("pii")).alias("safe")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r["doc_id"]] or "")
        assert r["base"] == ",".join(want), texts[r["doc_id"]][:80]
        assert r["all"].startswith(r["base"])
        spans = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in r["all"].split(",") if s))
        safe, at, merged = "", 0, []
        for a, b, k in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], -b)
            else:
                merged.append([a, -b, k])
        for a, b, k in merged:
            safe, at = safe + r["whole_text"][at:a] + f"[{k.upper()}]", b
        assert r["safe"] == safe + r["whole_text"][at:]
    assert find_pii(docs, keep=("doc_id",)).count() == len(rows)


def test_pii_added_spans(spark):
    from sluice.llm.pii import find_pii, listed

    texts = ["please call me at 212-555-0144 today", 'the password = "9f8a7b6c5d4e3f2a1b0c" works', "write to someone (at) example (dot) com now", "order 1234567890 shipped", "version 1.22.3456.7 of", "commit 9f8a7b6c5d4e3f2a1b0c9f8a7b6c5d4e3f2a1b0c merged", "plain words only"]
    got = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), keep=("doc_id",)).select("doc_id", listed(F.col("pii")).alias("s")).orderBy("doc_id").collect()
    assert [bool(r["s"]) for r in got] == [True, True, True, False, False, False, False]
    assert [r["s"].split(":")[0] for r in got[:3]] == ["number", "secret", "address"]


#: Forms of personal data and of harmless text that no form of the fitting or calibrating part repeats.
UNSEEN = (
    (1, "you can ring 9##-###-#### if it rains"), (1, "his cell is 9##.###.#### or so"), (1, "Tel.: (9##) ###-####."), (1, "mobile 0#### ######"), (1, "ask for 06 ## ## ## ## 07 ## ## ## ##"), (1, "text 9## ### #### for help"),
    (1, "my ssn is ###-##-####"), (1, "passport number ######### expires"), (1, "wire it to account ########### today"), (1, "she left (9##)###-#### on the desk"), (1, "WhatsApp 0### #######"),
    (1, 'DB_PASSWORD="?#*?#*?#*?#*"'), (1, "api-key: ************************"), (1, "SECRET_KEY = '~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~'"), (1, "Authorization: Bearer ****************************************"), (1, 'access_token="~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"'),
    (1, "export AWS=AKIA^#^^#^^#^^#^^#^#"), (1, "pushed gho_************************************ by mistake"), (1, "curl -u sk_test_************************"), (1, "the wifi password: ?????##?#"), (1, "pwd=^???##??!"), (1, "login token: ********************"), (1, "xoxp-##########-##########-************************"),
    (1, "?????? (at) ??????? (dot) org wrote back"), (1, "Contact ???.????? [at] ???? [dot] co"), (1, "my address is ????? at ?????? dot com"), (1, "?????##(at)?????(dot)net"), (1, "mail ???? AT ????? DOT org"),
    (0, "git hash ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~ broke it"), (0, "request ~~~~~~~~-~~~~-~~~~-~~~~-~~~~~~~~~~~~ failed"), (0, "saved as report-~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~.pdf"), (0, "main.~~~~~~~~~~~~~~~~~~~~.chunk.js"), (0, "sha256 ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~ ok"),
    (0, "md5sum: ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"), (0, "published 20##-0#-1# in print"), (0, "from 18## - 19## it stood"), (0, "a population of 9 ### ### people"), (0, "measured 9####.###### units"), (0, "order no. ########## was sent"), (0, "isbn 978-#-##-######-#"),
    (0, "rows 1###### to 2######"), (0, "at ????? we met"), (0, "he looked at ???? dot ??? patterns"), (0, "password must be long"), (0, "the token is invalid here"), (0, "password: string;"), (0, "see /???/???????/20##/0#/???????-??????"), (0, "the ????????????????? of 19##"),
    (0, "version 1#.##.####.## came out"), (0, "coordinates ##.####### ##.#######"), (0, "serial ####-####-##"), (0, "in 19## 19## 20## and 20##"), (0, "class ???????_??????????_20##_??? here"), (0, "ticket ######## closed"), (0, "api key = None"), (0, "a total of 1,###,### in ####"),
)


#: Code that must stay, and personal data without the usual separators; also absent from fitting and calibration.
PLAIN = (
    (0, "def get_user_by_name_4#_v2(self)"), (0, "call to_utf8_string_16bit_v3 here"), (0, "import parse_http2_header_lines_v1"), (0, "the kebab-case-module-name-2#24-final file"), (0, "MAX_BUFFER_SIZE_1#24_BYTES is set"),
    (0, "camelCaseIdentifierNumber2Handler runs"), (0, "layer3_conv2d_batch_norm_1 output"), (0, "test_foo_bar_baz_case_1# fails"), (0, "key word2vec_embedding_layer_## of it"), (0, "token bucket_rate_limiter_v# works"),
    (0, "the password policy of the house"), (0, "key signature_block_##"), (0, "code review_of_2#24 is open"), (0, "src-main-resources-static-v##-build"), (0, "a member since 2###"),
    (1, "log in with password ??##??##!"), (1, "use password ^????##??# for it"), (1, "the wifi password #?#?#?#?"), (1, "passphrase ???##???#?? opens it"), (1, "secret ^^##??##^^?? was sent"),
    (1, "member #########"), (1, "her policy number is ##########"), (1, "customer ######### called"), (1, "patient ######### came in"),
)


def test_pii_leaves_code_and_finds_bare_forms(spark):
    from sluice.llm.pii import ADDED, FORMS, find_pii, made_sentences, of_kind

    assert not {f for _, f in PLAIN} & {f for _, f in FORMS}
    made = made_sentences(PLAIN, 20, seed=78)
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(made)], "doc_id int, text string")
    found = {r["doc_id"] for r in find_pii(df, keep=("doc_id",)).where(F.size(of_kind(F.col("pii"), *ADDED)) > 0).select("doc_id").collect()}
    right = sum(y and i in found for i, (_, y, _) in enumerate(made))
    wrong = collections.Counter(PLAIN[k][1] for i, (k, y, _) in enumerate(made) if y != (i in found))
    recall, precision = right / sum(y for _, y, _ in made), right / max(1, len(found))
    print(f"recall {recall:.3f} precision {precision:.3f}", wrong)
    assert recall >= 0.9 and precision >= 0.9, wrong


def test_pii_on_unseen_forms(spark):
    """Recall and precision of the added spans on forms absent from fitting and calibration: the figures of the README."""
    from sluice.llm.pii import ADDED, FORMS, find_pii, made_sentences, of_kind

    assert not {f for _, f in UNSEEN} & {f for _, f in FORMS}
    made = made_sentences(UNSEEN, 20, seed=77)
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(made)], "doc_id int, text string")
    found = {r["doc_id"] for r in find_pii(df, keep=("doc_id",)).where(F.size(of_kind(F.col("pii"), *ADDED)) > 0).select("doc_id").collect()}
    right = sum(y and i in found for i, (_, y, _) in enumerate(made))
    wrong = collections.Counter(UNSEEN[k][1] for i, (k, y, _) in enumerate(made) if y != (i in found))
    recall, precision = right / sum(y for _, y, _ in made), right / max(1, len(found))
    print(f"recall {recall:.3f} precision {precision:.3f}", wrong)
    assert recall >= 0.9 and precision >= 0.9, wrong


def test_pii_time_follows_the_spans(spark):
    import time

    from sluice.llm.pii import find_pii, redact

    text = " and ".join(f"call 212-555-{i % 10000:04d}" if i % 2 else f"me{i}@x.org" for i in range(16000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    row = find_pii(df, keep=("doc_id",)).select(F.size("pii").alias("n"), redact(F.col("whole_text"), F.col("pii")).alias("safe")).first()
    assert row["n"] == 16000 and row["safe"] == " and ".join("call [NUMBER]" if i % 2 else "[EMAIL]" for i in range(16000))
    assert time.time() - began < 30


def test_pii_empty_table(empty):
    from sluice.llm.pii import find_pii

    assert find_pii(empty, keep=("doc_id",)).count() == 0


def test_scan(spark):
    from sluice.llm.pii import scan

    rng = random.Random(2)
    data = [[rng.randint(0, 99) for _ in range(n)] for n in (0, 1, 2, 3, 7, 8, 9, 100)]
    got = spark.createDataFrame([(x,) for x in data], "x array<int>").select(scan(F.col("x"), lambda a, b: a + b).alias("s"), scan(F.col("x"), F.greatest).alias("m")).collect()
    assert [r["s"] for r in got] == [np.cumsum(x).tolist() for x in data]
    assert [r["m"] for r in got] == [np.maximum.accumulate(x).tolist() if x else [] for x in data]


@pytest.mark.parametrize("sizes", [(60, 4, 1 << 20, 20), (100, 100, 300, 1 << 20), (8192, 200_000, 64 << 20, 1 << 22), (3, 2, 64 << 20, 1 << 22)])
def test_top_k(spark, monkeypatch, sizes):
    from sluice.llm import topk

    rng = np.random.default_rng(2)
    data = [(i, rng.normal(0, 0.2, 8).astype("float32").tolist()) for i in range(400)]
    data += [(400 + i, data[7][1]) for i in range(30)]  # ties
    data += [(430, None), (431, [None] + [0.1] * 7), (450, [float("nan")] + [0.1] * 7), (433, [float("inf")] * 8), (None, [0.1] * 8), (500, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumns({"shard": F.lit(1), "block": F.lit(2), "score": F.lit(3)})
    quant = topk.quantised(df)
    for name, value in zip(("SHARD_ROWS", "TASK_QUERIES", "BOUND_BYTES", "CELLS"), sizes):
        monkeypatch.setattr(topk, name, value)
    got = topk.top_k(quant, quant.where("vec_id % 50 = 0"), 5).collect()
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in whole:
        if q % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)}
    assert {tuple(r) for r in got} == want
    few = quant.where("vec_id IN (0, 50)")
    assert sorted((r["query_id"], r["vec_id"]) for r in topk.top_k(few, few, 5).collect()) == [(0, 50), (50, 0)]
    assert topk.top_k(few.where("false"), few.where("false"), 5).count() == 0
    assert topk.top_k(few, few.where("false"), 5).count() == 0 and topk.top_k(few.where("false"), few, 5).count() == 0
    with pytest.raises(ValueError, match="exact"):
        topk.top_k(*[spark.createDataFrame([(1, [1 << 40]), (2, [1 << 40])], "vec_id bigint, embedding array<bigint>")] * 2)
    uneven = spark.createDataFrame([(0, [1, 2, 3]), (1, [5]), (2, [-1, 4]), (2, [-1, 4])], "vec_id bigint, embedding array<bigint>")
    assert sorted(map(tuple, topk.top_k(uneven, uneven.where("vec_id < 2"), 2).collect())) == [(0, 1, 2, 7), (0, 2, 2, 7), (1, 1, 0, 5), (1, 2, 2, -5)]


def test_queries_skip_shards_that_cannot_reach_them():
    from sluice.llm.topk import _route

    class Held:
        value = (np.array([4, 7, 9], np.int32), np.array([[-9.0, -9], [1, 1], [-9, -9]]), np.array([[-1.0, -1], [9, 9], [0, 2]]))

    import pyarrow as pa

    batch = pa.record_batch([pa.array([1, 2]), pa.array([[1.0, 2.0], [-1.0, 0.0]]), pa.array([3.0, 5.0])], names=["query_id", "vector", "least"])
    sent = [(r["query_id"], r["shard"]) for b in _route(iter([batch]), Held, False) for r in b.to_pylist()]
    assert sent == [(1, 7), (1, 9), (2, 4), (2, 9)]
    assert [(r["query_id"], r["shard"]) for b in _route(iter([batch]), Held, True) for r in b.to_pylist()] == [(1, 7), (2, 4)]


def test_max_score_prunes_and_is_exact():
    from sluice.llm.topk import best, max_score

    rng = np.random.default_rng(0)
    terms = np.floor(rng.normal(0, 10, (16, 500)) * (2.0 ** -np.arange(16))[:, None] * 50)
    ids = rng.permutation(500)
    for _ in range(20):
        query = np.floor(rng.normal(0, 20, 16))
        rows, scores = max_score(query, -1, ids, terms, terms.min(axis=1), terms.max(axis=1), 5)
        want = best(ids, query @ terms, 5)
        assert rows.tolist() == want.tolist() and scores.tolist() == (query @ terms)[want].tolist()


@pytest.mark.parametrize(("size", "direct", "only", "tuning"), [(4000, 1024, None, 1), (1500, 3, None, 1), (1 << 20, 1024, None, 1), (4000, 1024, range(60, 75), 1), (4000, 1024, None, None), (1500, 3, None, None)])
def test_language_model(docs, rows, empty, monkeypatch, size, direct, only, tuning):
    """Counts, weights and scores against token-by-token versions; one or many chunks, asking in one step or two."""
    from sluice.llm import lm

    seen = []
    learn = lm.expectation_maximisation
    monkeypatch.setattr(lm, "CHUNK_BYTES", size)
    monkeypatch.setattr(lm, "DIRECT", direct)
    monkeypatch.setattr(lm, "expectation_maximisation", lambda *a: seen.append(learn(*a)) or seen[-1])
    if only is not None:  # none of these has the remainder that tunes
        only = [i for i in only if zlib.crc32(str(i).encode()) % 10 != 1]
        docs, rows = docs.where(F.col("doc_id").isin(only)), [r for r in rows if r[0] in only]
    got = collections.Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in lm.score_documents(docs, **({} if tuning is None else {"tuning": tuning})).collect())
    weights = seen[-1]
    tokens = [(i, [*words(t), "\n"]) for i, t, *_ in rows]
    left = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    learned = [(i, w) for i, w in tokens if left(i) not in (None, 0)]
    count = collections.Counter(x for _, w in learned for x in w)
    pairs = collections.Counter(p for _, w in learned for p in zip(["\n", *w], w))
    n, v = sum(count.values()), len(count)
    kind = lambda c: min(int(math.log2(c)) + 1, lm.CONTEXTS - 1) if c > 0 else 0
    tune = [w for i, w in learned if left(i) == tuning] or [w for _, w in learned]
    cells = [(kind(count[h] - 1), (pairs[h, x] - 1) / max(count[h] - 1, 1), (count[x] - 1) / (n - 1)) for w in tune for h, x in zip(["\n", *w], w)]
    want = learn(np.array([c[0] for c in cells]), np.array([[p, s, 1 / (v + 1)] for _, p, s in cells]), np.ones(len(cells)))
    assert np.abs(weights - want).max() < 0.01 and np.allclose(weights.sum(axis=1), 1)
    expected = collections.Counter()
    for i, w in tokens:
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for h, x in zip(["\n", *w], w):
            a, b, c = weights[kind(count[h])]
            score += math.log10(a * pairs[h, x] / max(count[h], 1) + b * count[x] / n + c / (v + 1))
        expected[i, left(i) == 0, len(w), sum(count[x] > 0 for x in w), n, round(base, 6), round(score, 6)] += 1
    near = lambda c: sorted((str(k[0]), *k[1:5], round(k[5], 3), round(k[6], 3), m) for k, m in c.items())
    assert near(got) == near(expected)
    scored = [k for k in got if left(k[0]) == 0 and k[2] > 5]
    assert only or sum(k[6] for k in scored) > sum(k[5] for k in scored)
    assert lm.score_documents(empty).count() == 0


def test_mixture_weights_are_learned():
    from sluice.llm.lm import expectation_maximisation

    rng = np.random.default_rng(1)
    source = rng.random(4000) < 0.7
    estimates = np.stack([np.where(source, 0.5, 1e-6), np.where(source, 1e-6, 0.5), np.full(4000, 1e-9)], axis=1)
    weights = expectation_maximisation(np.full(4000, 3), estimates, np.ones(4000))
    assert abs(weights[3, 0] - source.mean()) < 0.02 and np.allclose(weights.sum(axis=1), 1)


def test_decontamination(spark, empty):
    from sluice.llm import decontam

    rng = random.Random(8)
    items = [(i, sentence(rng, "en", 30)) for i in range(12)] + [(20, None), (21, "short"), (22, "")]
    plain = [(i, sentence(rng, lang, 80)) for i, lang in enumerate(["fr", "de"] * 20)]
    edited = items[2][1][:40] + "Z" + items[2][1][42:90] + "qq" + items[2][1][90:]
    cases = [(100, plain[0][1] + " " + items[0][1] + " " + plain[1][1]), (101, items[1][1].upper().replace(" ", "\n ")), (102, edited), (103, plain[2][1] + items[3][1][: len(items[3][1]) // 2 + 60]), (104, None), (105, ""), (106, items[4][1] + items[5][1]), (106, items[4][1] + items[5][1])]
    docs = spark.createDataFrame(plain + cases, "doc_id bigint, text string").withColumns({"item_id": F.lit(1), "windows": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(5))
    for size, wide in ((decontam.ITEM_BYTES, decontam.FILTER_BYTES), (700, 1500), (700, decontam.FILTER_BYTES)):
        keep, decontam.ITEM_BYTES, decontam.FILTER_BYTES = (decontam.ITEM_BYTES, decontam.FILTER_BYTES), size, wide
        try:
            got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontam.find_contamination(docs, bench).collect())
        finally:
            decontam.ITEM_BYTES, decontam.FILTER_BYTES = keep
        assert {k: n for k, n in got.items() if k[0] >= 100} == {(100, 0): 1, (101, 1): 1, (102, 2): 1, (103, 3): 1, (106, 4): 2, (106, 5): 2}
        assert not [k for k in got if k[0] < 100]
    assert decontam.find_contamination(empty, bench).count() == 0
    assert decontam.find_contamination(docs, bench.where("false")).count() == 0


def test_windows_are_found_in_their_own_row():
    from sluice.llm.decontam import Index, normal_all, search

    text = b"the quick brown fox jumps over the lazy dog and runs away from all the others there"
    rows = [text, text[:40] + b"z" + text[41:], text]
    data, starts = normal_all(rows)
    assert sorted((r, *found) for (r, _), found in search(data, starts, Index([(1, text)])).items()) == [(0, 0, len(text), 0), (1, 0, len(text), 1), (2, 0, len(text), 0)]


def distance(window, text):
    """Fewest edits of the window against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        last, row = row, [i + 1]
        for j, d in enumerate(text):
            row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
    return min(row)


def test_q_gram_search_finds_all_within_budget():
    from sluice.llm.decontam import Index, normal_all, search

    rng = random.Random(4)
    for _ in range(60):
        window = bytes(rng.choices(b"abcdefgh ", k=rng.choice([40, 90, 100]))).strip().replace(b"  ", b"xy")
        text = bytearray(window)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice([b"", b"z", b"k"])
        whole = bytes(rng.choices(b"mnopqrst", k=60)) + bytes(text) + bytes(rng.choices(b"mnopqrst", k=60))
        index = Index([(1, window)])
        data, starts = normal_all([whole])
        found = list(search(data, starts, index).values())
        from sluice.llm.decontam import normal

        want = distance(index.windows[0].tobytes(), normal(whole)) <= index.budget[0]
        assert bool(found) == want
        if found and found[0][2]:
            assert found[0][2] == distance(index.windows[0].tobytes(), normal(whole))


def test_passages_are_found_wherever_they_begin(spark):
    from sluice.llm.decontam import PASSAGES, find_contamination

    size, rng = PASSAGES[0][0], random.Random(12)
    item = " ".join(sentence(rng, "en", 60).split())
    cuts = list(range(1, len(item) - size, 7))
    texts = [(i, sentence(rng, "fr", 20) + "q" + item[at : at + size] + "q" + sentence(rng, "de", 20)) for i, at in enumerate(cuts)]
    docs = spark.createDataFrame(texts + [(1000, sentence(rng, "en", 60))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in find_contamination(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert set(got) == set(range(len(cuts)))
    for i, at in enumerate(cuts):
        place = texts[i][1].encode().index(b"q" + item[at : at + size].encode() + b"q") + 1
        assert got[i]["item_id"] == 7 and got[i]["edits"] == 0 and got[i]["start"] <= place and got[i]["end"] >= place + size


def test_passages_are_found_within_their_edits_only():
    from sluice.llm.decontam import PASSAGES, Index, matches, normal_all

    rng, seen = random.Random(14), collections.Counter()
    for _ in range(40):
        item = bytes(rng.choices(b"abcdefgh", k=rng.choice([70, 110, 150])))
        size, most = rng.choice(PASSAGES)
        at = rng.randrange(max(1, len(item) - size))
        text = bytearray(item[at : at + size])
        for place in sorted(rng.sample(range(len(text)), rng.randint(0, most + 2)), reverse=True):
            text[place : place + rng.randint(0, 1)] = rng.choice([b"", b"z", b"k"])
        whole = bytes(rng.choices(b"mnopqrst", k=40)) + bytes(text) + bytes(rng.choices(b"mnopqrst", k=40))
        index = Index([(1, item)])
        data, starts = normal_all([b"other text", whole, item[:9]])
        found = matches(data, starts, index)
        want = any(distance(item[p : p + n], whole) <= k for n, k in PASSAGES for p in range(len(item) - n + 1))
        want = want or any(distance(w.tobytes(), whole) <= k for w, k in zip(index.windows, index.budget))
        assert {r for r, *_ in found} == ({1} if want else set())
        seen[want] += 1
    assert min(seen[True], seen[False]) >= 5


def test_runs_and_blocks_change_nothing(monkeypatch):
    """Texts with long runs, hits in small blocks and parts of the index: the same pairs as with all at once."""
    from sluice.llm import decontam
    from sluice.llm.decontam import Index, matches, normal_all

    rng, seen = random.Random(23), 0
    for _ in range(8):
        pieces = [bytes(rng.choices(b"abc-", k=rng.randint(1, 5))) * rng.randint(1, 400) for _ in range(4)] + [bytes(rng.choices(b"abcdefgh ", k=90)) for _ in range(2)]
        items = [(i, b"".join(rng.choices(pieces, k=2))[: rng.randint(8, 400)]) for i in range(6)] + [(9, pieces[0][:300]), (10, pieces[0][:300])]
        rows = [b"".join(rng.choices(pieces, k=4)) for _ in range(5)] + [b"", items[0][1]]
        data, starts = normal_all(rows)
        with monkeypatch.context() as m:
            m.setattr(decontam, "PERIODS", 0)
            m.setattr(decontam, "POSTINGS", 1 << 40)
            whole = matches(data, starts, Index(items))
        with monkeypatch.context() as m:
            m.setattr(decontam, "POSTINGS", rng.choice([5000, 30_000]))
            parts = matches(data, starts, Index(items))
        fewest = lambda found: {k: min(x[5] for x in found if x[:2] == k) for k in {x[:2] for x in found}}
        assert fewest(whole) == fewest(parts)
        count = lambda found: collections.Counter(x[:2] for x in set(found) if x[2])
        assert set(count(whole)) == set(count(parts))
        edge = lambda found, k: (min(x[3] for x in found if x[:2] == k), max(x[4] for x in found if x[:2] == k))
        assert all(a[0] >= 0 and a[1] <= len(normal_all([rows[k[0]]])[0]) for k in fewest(parts) for a in [edge(parts, k)])
        seen += len(fewest(whole))
    assert seen > 30


def test_long_text_of_one_byte():
    """5 MB of one byte against items of it: bounded memory, time in proportion to what differs."""
    import time

    from sluice.llm.decontam import Index, matches, normal_all

    index = Index([(1, b"a" * 100), (2, b"a" * 5000 + b"b"), (3, b"-" * 40), (4, b"ab" * 60)])
    data, starts = normal_all([b"a" * 5_000_000, b"x" + b"-" * 1_000_000, b"ab" * 500_000 + b" " + b"- " * 100_000])
    began = time.time()
    found = matches(data, starts, index)
    assert {x[:2] for x in found} >= {(0, 1), (0, 2), (1, 3), (2, 4)} and (0, 3) not in {x[:2] for x in found}
    assert min(x[3] for x in found if x[:2] == (0, 1)) == 0 and max(x[4] for x in found if x[:2] == (0, 1)) == 5_000_000
    assert time.time() - began < 60


def ids_of(name, text, whole):
    from tokenizers import Tokenizer
    import public_tokenizers

    if name not in whole:
        whole[name] = Tokenizer.from_file(public_tokenizers.path(name))
        whole[name].encode_special_tokens = True
    return whole[name].encode(text or "", add_special_tokens=False).ids + [0]


ODD = ["a  b  c", "  lead and trail \n", "it's we'll don't,x. A'S 'st,", "Σας ΣΑΣ. é, x", "\x1c a\x1cb", "日本語,text.1234", "<|endoftext|> a<|startoftext|>", "a\t\tb\r\n c", "!!! ,,, a,.b", "é,́x ﬁ", "é×,÷. a_b c≠d", "a   b", " ", "\n\n", "x  　y", "don't.Stop"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_content_store(spark, docs, rows, empty):
    from sluice.llm import store

    data, tools = [(i, t) for i, t, *_ in rows] + [(1000 + k, t) for k, t in enumerate(ODD)], {}
    path = store.store_path(spark)
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([x for x in data if x[0] and x[0] >= 1000], "doc_id bigint, text string"))
    store.write_store(df.repartition(3), path)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in store.read_store(spark, path).collect()]
    want = collections.Counter((i, len(x), crc(x)) for i, x in ((i, ids_of(store.VOCABULARY, t, tools)) for i, t in data))
    assert collections.Counter((d, n, c) for d, _, n, c in got) == want
    at = 0
    for doc, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    assert store.read_ids(spark, path, 156) == ids_of(store.VOCABULARY, rows[156][1], tools)
    objects = spark.read.parquet(f"{path}/objects").select("key")
    assert objects.count() == objects.distinct().count()
    bare = store.store_path(spark)
    store.write_store(empty, bare)
    assert store.read_store(spark, bare).count() == 0


@pytest.mark.parametrize("share", [1, 10_000])
def test_store_with_a_chunk_in_most_documents(spark, monkeypatch, share):
    """The same rows whether no chunk counts as common or nearly all do; a common chunk that is missing raises."""
    from sluice.llm import store

    monkeypatch.setattr(store, "COMMON", share)
    shared = " ".join(f"word{i * 7919 % 1000}" for i in range(300))
    data = [(i, shared if i % 7 else f"{shared} tail {i}") for i in range(30)] + [(30, ""), (31, None)]
    path, tools = store.store_path(spark), {}
    store.write_store(spark.createDataFrame(data, "doc_id bigint, text string").repartition(4), path)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in store.read_store(spark, path).collect())
    want = {t: ids_of(store.VOCABULARY, t, tools) for _, t in data}
    assert got == [(i, len(want[t]), crc(want[t])) for i, t in data]
    if share == 1:
        return
    objects = spark.read.parquet(f"{path}/objects")
    recipe = spark.read.parquet(f"{path}/recipes").where("doc_id = 1").first()["digests"]
    objects.where(F.col("key") != F.lit(recipe[:32])).write.partitionBy("kind").parquet(f"{path}/objects2")
    monkeypatch.setattr(store, "verify_manifest", lambda spark, path, root: store.manifest_of(spark, path))
    files = spark._jvm.org.apache.hadoop.fs.Path
    system = files(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(files(f"{path}/objects"), True)
    system.rename(files(f"{path}/objects2"), files(f"{path}/objects"))
    with pytest.raises(Exception, match="does not match its recipe"):
        store.read_store(spark, path).collect()


def test_store_notices_damage(spark, tmp_path):
    from sluice.llm import store

    path = f"file://{tmp_path}/s"
    store.write_store(spark.createDataFrame([(1, "some text here")], "doc_id bigint, text string"), path)
    bad = spark.read.parquet(f"{path}/objects").withColumn("payload", F.concat("payload", F.lit(b"\0\0")))
    bad.write.partitionBy("kind").parquet(f"{path}/objects2")
    import shutil

    shutil.rmtree(tmp_path / "s/objects")
    shutil.move(tmp_path / "s/objects2", tmp_path / "s/objects")
    with pytest.raises(Exception, match="does not match"):
        store.read_store(spark, path).collect()


@pytest.mark.parametrize("damage", ["remove", "remove file", "swap", "reorder", "repeat", "length", "nothing"])
def test_manifest_notices_damaged_recipes(spark, docs, tmp_path, damage):
    import shutil

    from sluice.llm import store

    path = f"file://{tmp_path}/s"
    root = store.write_store(docs.where("doc_id BETWEEN 1 AND 40").repartition(3), path)
    recipes = spark.read.parquet(f"{path}/recipes")
    ids = sorted(r["doc_id"] for r in recipes.collect())
    a, b = ids[10], ids[11]
    start, length = (dict(map(tuple, recipes.select("doc_id", c).collect())) for c in ("local_start", "n_tokens"))
    other = F.when(F.col("doc_id") == a, b).when(F.col("doc_id") == b, a).otherwise(F.col("doc_id"))
    at = F.when(F.col("doc_id") == a, start[a] + length[b]).when(F.col("doc_id") == b, start[a]).otherwise(F.col("local_start"))
    changed = {
        "remove": recipes.where(F.col("doc_id") != ids[-1]),
        "remove file": recipes.where(F.col("part") != recipes.agg(F.max("part")).first()[0]),
        "swap": recipes.withColumn("doc_id", other),
        "reorder": recipes.withColumn("local_start", at),
        "repeat": recipes.unionByName(recipes.where(F.col("doc_id") == a)),
        "length": recipes.withColumn("n_tokens", F.col("n_tokens") + F.when(F.col("doc_id") == ids[-1], 1).otherwise(0)),
        "nothing": recipes,
    }[damage]
    changed.write.parquet(f"{path}/recipes2")
    shutil.rmtree(tmp_path / "s/recipes")
    shutil.move(tmp_path / "s/recipes2", tmp_path / "s/recipes")
    if damage == "nothing":
        assert store.read_store(spark, path, root=root).count() == len(ids)
        with pytest.raises(ValueError, match="not the one asked for"):
            store.read_store(spark, path, root="00")
    else:
        with pytest.raises(Exception, match="manifest|gap or an overlap"):
            store.read_store(spark, path).collect()


def test_crc_join_and_cuts():
    from sluice.llm.store import LEAST, MOST, chunk_ends, crc_join, rolling_cuts

    rng = np.random.default_rng(0)
    a, b = rng.bytes(123), rng.bytes(77)
    assert crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and crc_join(zlib.crc32(a), 0, 0) == zlib.crc32(a)
    ids = rng.integers(0, 50_000, 60_000).astype("<u4")
    ends = chunk_ends(0, len(ids), rolling_cuts(ids))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes[:-1].min() >= LEAST and sizes.max() <= MOST
    shifted = np.concatenate([ids[:7], ids])  # an insertion moves the cuts with the text
    moved = set(chunk_ends(0, len(shifted), rolling_cuts(shifted)))
    assert len({e + 7 for e in ends} & moved) > 0.9 * len(ends)


def test_warc(spark):
    from sluice.llm import warc
    from sluice.llm.common import Scratch

    tricky = "<p>" + "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3 + "</p>"
    data = [(5, "http://a/ b\r\nX: y", "x" * 100), (3, None, "x" * 100), (9, "u", "x" * 100), (4, "u", "x" * 99), (6, "u", "x" * 99), (10, "u", None), (11, "u", ""), (12, "u", tricky), (13, "u", tricky), (14, "u", "é" * 60), (14, "u", "é" * 60), (None, "u", "x" * 100), (None, "u", "alone" * 50), (15, "u", "\r\n\r\n"), (16, "u", "z" * 200_000)]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(2), "size": F.lit(3), "id": F.lit(4)})
    path = Scratch(spark, "warc-test").path("a")
    warc.write_warc(pages.repartition(2), path)
    got = collections.Counter(map(tuple, warc.read_warc(spark, path).collect()))
    want = collections.Counter()
    for i, _, html in data:
        body = (html or "").encode()
        ids = [j for j, _, h in data if (h or "").encode() == body and j is not None]
        first = min(ids) if ids and len(body) >= 100 else None
        again = first is not None and first != i
        want[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    bare = Scratch(spark, "warc-test").path("b")
    warc.write_warc(pages.where("false"), bare)
    assert warc.read_warc(spark, bare).count() == 0


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of 40,000 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "40000", "spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_file_over_several_tasks(spark, tmp_path, small_ranges, compression):
    """One file in many ranges; payloads full of magic, of whole records, of parts of the magic, some longer than ranges."""
    from sluice.llm import warc

    rng = random.Random(7)
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: {}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    parts = ["WARC/1.1\r\n", "WARC/1.", "WARC/1.1\r", "W", "WARC/1.WARC/1.1\r\n", "\r\n\r\n", "é", inner.format(3), inner.format(40), inner.format(10**17), "some text "]
    data = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 40, 300])))) for i in range(150)]
    data += [(200, "WARC/1.1\r\n" * 30_000), (201, "y" * 130_000), (202, inner.format(9) * 1000), (203, "WARC/1.1\r\n"), (204, "z")]
    pages = spark.createDataFrame(data, "page_id bigint, html string").withColumn("url", F.lit("u"))
    path = f"file://{tmp_path}/a"
    warc.write_warc(pages.coalesce(1), path, compression=compression)
    lines = warc.read_lines(spark, path)
    assert (lines.select("file", "block").distinct().count() > 10) == (compression == "none")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_warc(spark, path).collect())
    assert got == collections.Counter((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest()) for i, h in data)


def test_long_payload_of_magic(spark, tmp_path):
    from sluice.llm import warc

    body = "WARC/1.1\r\nContent-Length: 10\r\n\r\n" * 530_000
    assert len(body) > 16 << 20
    path = f"file://{tmp_path}/a"
    warc.write_warc(spark.createDataFrame([(1, body), (2, "after")], "page_id bigint, html string").withColumn("url", F.lit("u")).coalesce(1), path)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.read_warc(spark, path).collect()) == [(1, len(body)), (2, 5)]


def test_damaged_archives_are_refused(spark, tmp_path):
    from sluice.llm import warc

    warc.write_warc(spark.createDataFrame([(i, "u", f"page {i} WARC/1.1\r\n" + "x" * 50) for i in range(5)], "page_id bigint, url string, html string").coalesce(1), f"file://{tmp_path}/a")
    good = next((tmp_path / "a").glob("part*")).read_bytes()
    for k, data in enumerate((good[:-1], b"x" + good, good + b"junk", good + warc.MAGIC, good[10:], good.replace(b"page 3", b"page 4"), b"no record", warc.MAGIC, good.replace(b"Content-Length: ", b"Contend-Length: "))):
        (tmp_path / f"b{k}").mkdir()
        (tmp_path / f"b{k}/part-0").write_bytes(data)
        with pytest.raises(Exception, match="breaks off|does not match"):
            warc.read_warc(spark, f"file://{tmp_path}/b{k}").collect()


def test_chains_by_pointer_jumping(spark):
    from sluice.llm.common import Scratch
    from sluice.llm.warc import chain_entries, exits, reached

    starts, nexts = np.array([0, 5, 7, 12, 20]), np.array([7, 9, 20, 13, 31])
    assert reached(starts, nexts, 0).tolist() == [True, False, True, False, True]
    assert exits(starts, nexts).tolist() == [31, 9, 31, 13, 31]
    assert exits(starts[:0], nexts[:0]).tolist() == []
    steps = spark.createDataFrame([("f", 10 * i, 10 * i + 10) for i in range(9)] + [("g", 0, 4), ("f", 3, 20)], "file string, start long, leave long")
    met = chain_entries(steps.where("start = 0").select("file", "start"), steps, 4, Scratch(spark, "t"))
    assert sorted(map(tuple, met.collect())) == [("f", 10 * i) for i in range(10)] + [("g", 0), ("g", 4)]


def test_language_id(spark, docs, rows, empty):
    from sluice.llm.langid import UNDETERMINED, identify

    got = identify(docs).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, *_ in rows)
    by = {r["doc_id"]: r for r in got}
    held = [(i, lang) for i, t, lang, *_ in rows[:120] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i]["held_out"] for i, _ in held)
    assert sum(by[i]["lang_pred"] == lang for i, lang in held) >= 0.95 * len(held)
    for i in (150, 151, 152, 155):
        assert (by[i]["lang_pred"], by[i]["score"]) == (UNDETERMINED, 0.0)
    assert by[157]["lang_pred"] in WORDS and all(0 <= r["score"] <= 1 for r in got)
    rng = random.Random(2)
    mixed = sentence(rng, "fr", 40) + " " + sentence(rng, "de", 25)
    one = identify(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(9000, mixed, None)], "doc_id bigint, text string, lang string"))).where("doc_id = 9000").first()
    assert [s["lang"] for s in one["spans"]] == ["fr", "de"] and abs(one["spans"][1]["first_word"] - 40) <= 2
    assert identify(empty).count() == 0
    assert identify(docs.where("lang IS NULL")).where("lang_pred <> 'und'").count() == 0


def test_viterbi_and_its_shortcut():
    from sluice.llm.langid import label_words, viterbi

    rng = np.random.default_rng(3)
    for n in (1, 2, 3):
        for _ in range(40):
            s = rng.normal(0, 2, (rng.integers(1, 7), n)).astype(np.float32)
            penalty = 1.5
            value = lambda p, s=s: sum(s[t, x] for t, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
            import itertools

            best = max(value(p) for p in itertools.product(range(n), repeat=len(s)))
            assert abs(value(viterbi([s], penalty)[0].tolist()) - best) < 1e-4
            assert abs(value(label_words(s, np.array([0, len(s)]), penalty).tolist()) - best) < 1e-4


def test_resampling(spark, docs, rows, empty):
    """Weights against models of plain word counts, bucket by bucket; the draw against the sorted keys."""
    from sluice.llm.resample import SMOOTH, features, kth_largest, resample

    labels = spark.createDataFrame([(i, int(lang == "en"), 0) for i, _, lang, *_ in rows[:90]] + [(None, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    got = resample(docs, labels, 0.4).collect()
    assert len(got) == len(rows)

    def grams(text):
        w = words(text)
        return [*((x,) for x in w), *zip(w, w[1:])]

    every = {g for _, t, *_ in rows for g in grams(t)}
    bucket = {g: int(features([" ".join(g).encode()])[1][-1]) for g in every}
    counted = [collections.Counter(bucket[g] for g in grams(t)) for _, t, *_ in rows]
    good = {i for i, _, lang, *_ in rows[:90] if lang == "en"}
    raw, target = (sum((c for c, r in zip(counted, rows) if keep(r[0])), collections.Counter()) for keep in (lambda i: True, good.__contains__))
    want = collections.Counter()
    for (i, *_), own in zip(rows, counted):
        out = own if i in good else {}
        size, left = sum(raw.values()) - sum(out.values()), sum(target.values()) - sum(out.values())
        weight = sum(n * math.log((target[b] - out.get(b, 0) + SMOOTH) / ((raw[b] - out.get(b, 0)) * left / size + SMOOTH)) for b, n in own.items())
        want[i, sum(own.values()), round(weight, 6) + 0.0] += 1
    assert collections.Counter((r["doc_id"], r["n_features"], round(r["log_weight"], 6) + 0.0) for r in got) == want
    english = {i for i, _, lang, *_ in rows[:120] if lang == "en"}
    mean = lambda keep: np.mean([r["log_weight"] / max(r["n_features"], 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 120 and (r["doc_id"] in english) == keep])
    assert mean(True) > mean(False)
    want = math.ceil(0.4 * len(rows))
    assert want <= sum(r["selected"] for r in got) <= want + 3
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    assert {r["gumbel_key"] for r in got if r["selected"]} == set(keys[:want])
    assert resample(empty, labels).count() == 0
    assert all(r["log_weight"] == 0 for r in resample(docs, labels.where("false")).collect())
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 2, 5, 5, 1e9, -3]], "x double")
    assert [kth_largest(df, "x", k) for k in range(1, 9)] == [1e9, 5, 5, 2, 1, 1, 1, -3]


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    stages = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    return sum(x.shuffleWriteBytes() for x in stages)


def test_jaccard_shuffles_little(spark, tmp_path):
    """Prefixes are dealt twice (to their class, by token), texts only where they are compared: disk is a multiple of the input."""
    from sluice.llm.jaccard import near_duplicates

    rng = random.Random(11)
    texts = [[f"{rng.getrandbits(24):x}" for _ in range(300)] for _ in range(3000)]
    texts += [t[:150] + ["other"] + t[151:] for t in texts[:30]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    before, broadcast = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        got = near_duplicates(spark.read.parquet(str(tmp_path / "docs")), 4, 85, count_links=True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    used = (shuffled(spark) - before) / sum(len(t) for _, t in rows)
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in got} == {i: (i % 3000, int(i % 3000 < 30)) for i in range(3030)}
    assert used < 1.2, used


def test_packing_memory(monkeypatch):
    """A pipeline's worker that packs keeps few segments and encodes little text at a time; what it forgot is encoded again."""
    import pyarrow as pa

    import corpus_pipeline
    from sluice.llm import packing, tokens

    asked = []
    monkeypatch.setattr(corpus_pipeline, "pack_documents", lambda docs, **settings: asked.append(settings))
    corpus_pipeline.pack(None, None, "")
    texts = [" ".join(f"w{i * 60_000 + k}" for k in range(60_000)) for i in range(6)]
    largest, encode = [], tokens.Encoder.encode
    monkeypatch.setattr(tokens.Encoder, "encode", lambda self, rows: largest.append(sum(map(len, rows))) or encode(self, rows))
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts * 2)], names=["doc_id", "text"])
    tokens.forget()
    pieces = [r for b in packing._cut(iter([batch]), packing.VOCABULARY, packing.CAPACITY, **asked[0]) for r in b.to_pylist()]
    (encoder,) = tokens._OPEN.values()
    assert len(encoder.memo) <= 200_000 and max(largest) <= 1 << 20
    crcs = collections.defaultdict(list)
    for r in pieces:
        crcs[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert all(crcs[i] == crcs[i + 6] for i in range(6))
    whole = np.append(encoder._whole(texts[5].encode()), 0).astype("<u4")
    assert crcs[5] == [(a, len(whole[a : a + 2048]), zlib.crc32(whole[a : a + 2048].tobytes())) for a in range(0, len(whole), 2048)]
    tokens.forget()


def test_packing(spark, docs, rows, empty):
    from sluice.llm.packing import CAPACITY, VOCABULARY, pack_documents

    tools = {}
    data = [(i, t) for i, t, *_ in rows] + [(1000 + k, t) for k, t in enumerate(ODD)]
    df = docs.select("doc_id", "text", "length", "task").unionByName(spark.createDataFrame(data[len(rows) :], "doc_id bigint, text string"), allowMissingColumns=True)
    got = pack_documents(df.repartition(3)).collect()
    want = collections.Counter()
    for i, t in data:
        ids = ids_of(VOCABULARY, t, tools)
        for piece, at in enumerate(range(0, len(ids), CAPACITY)):
            part = ids[at : at + CAPACITY]
            want[i, piece, at, len(part), crc(part)] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], CAPACITY)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= math.ceil(total / CAPACITY) + 1
    assert pack_documents(empty).count() == 0


def check_sequences(rows, capacity):
    by = collections.defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity


def test_plans_use_as_few_sequences_as_can_be():
    from sluice.llm.packing import best_fit, plan, reduce_dominant

    rng = random.Random(6)

    def fewest(sizes, capacity):
        best = [len(sizes)]

        def place(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(rooms)
                return
            for i in {r: i for i, r in enumerate(rooms)}.values():
                if rooms[i] >= sizes[k]:
                    rooms[i] -= sizes[k]
                    place(k + 1, rooms)
                    rooms[i] += sizes[k]
            place(k + 1, [*rooms, capacity - sizes[k]])

        place(0, [])
        return best[0]

    worse = 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 30])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = collections.Counter(sizes)
        fixed, left = reduce_dominant(counts, capacity)
        assert all(sum(m) <= capacity for _, m in fixed)
        used = collections.Counter(left)
        for times, members in fixed:
            for m in members:
                used[m] += times
        assert used == counts
        least = fewest(sizes, capacity)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(t for t, _ in fixed) + fewest(rest, capacity) == least  # the reduction keeps an optimum
        worse += int(plan(counts, capacity)["sequences"][0]) > least
        groups = best_fit(counts, capacity)
        assert all(sum(m) <= capacity for _, m in groups) and sum(t * len(m) for t, m in groups) == len(sizes)
    assert worse <= 8


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    item = sentence(rng, "en", 40)
    data = [(i, sentence(rng, lang, 60), lang, "s", 1) for i, lang in enumerate(["en", "fr", "de"] * 20)]
    data += [(100, data[0][1] + " more", "en", "s", 1), (101, None, None, None, None), (102, "12 34 !!", "en", "s", 1), (103, sentence(rng, "en", 30) + " " + item, "en", "s", 1), (104, sentence(rng, "en", 40) + " x@y.org", "en", "s", 1)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append({r["doc_id"] for r in docs.collect()})
    every = {r[0] for r in data}
    assert seen[0] == every - {101, 102} and seen[1] == seen[0] - {100} and seen[2] == seen[1] - {103} and seen[3] == seen[2]
    assert docs.where("doc_id = 104").first()["text"].endswith(" [EMAIL]")
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"] for r in packed} == seen[3]


def test_pipeline_stages_with_empty_and_clashing_tables(spark, docs, empty, tmp_path):
    """Empty tables give empty ones; columns named like those used inside change nothing; equal rows stay once or go."""
    import corpus_pipeline

    spark.createDataFrame([(1, "some words of an item that no document holds")], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    names = {c: F.lit(5) for c in ("hash", "key", "other", "least", "row", "score", "lang_pred", "pii", "whole_text", "pii_text", "component_id", "copies")}
    plain, clashing, none = docs.select(*corpus_pipeline.COLUMNS), docs.withColumns(names), empty
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = [stage(spark, d, f"file://{tmp_path}") for d in (plain, clashing, none)]
        rows = [collections.Counter(map(str, d.drop("sequence_id", "offset").collect())) for d in out]
        assert rows[0] == rows[1] and rows[0] and not rows[2]
        if k == 4:
            break
        assert all(d.columns == list(corpus_pipeline.COLUMNS) for d in out)
        out[0].write.parquet(f"file://{tmp_path}/out-{k}")
        plain, none = spark.read.parquet(f"file://{tmp_path}/out-{k}"), out[2]
        clashing = plain.withColumns(names)
        if k == 1:
            assert max(collections.Counter(r["text"] for r in plain.where("doc_id IS NOT NULL").collect()).values()) == 1


def test_pipeline_stages_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(19)
    item = sentence(rng, "en", 40)
    text = [sentence(rng, lang, 60) for lang in ["en", "fr", "de"] * 20]
    plain = [(i, t, "en fr de".split()[i % 3], "s", 1) for i, t in enumerate(text)]
    clean, leak, one, two, three = sentence(rng, "en", 50), sentence(rng, "en", 30) + " " + item, sentence(rng, "en", 55), sentence(rng, "fr", 55), sentence(rng, "de", 55)
    odd = [(None, clean, "en", "s", 1), (None, leak, "en", "s", 1), (None, "12 34", None, "s", 1), (None, None, None, None, None)]
    odd += [(100, one, "en", "s", 1), (100, two, "fr", "s", 1), (100, three + " " + item, "de", "s", 1), (100, "12 34", "de", "s", 1), (100, two, "fr", "s", 1), (100, text[0] + " more", "en", "s", 1)]
    spark.createDataFrame(plain + odd, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/out-{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/out-{k}")
        seen.append(collections.Counter((r["doc_id"], r["text"]) for r in docs.collect()))
    rows = collections.Counter(r[:2] for r in plain)
    first = rows + collections.Counter(r[:2] for r in odd if r[1] not in (None, "12 34"))
    second = first - collections.Counter([(100, two), (100, text[0] + " more")])
    assert seen == [first, second, second - collections.Counter([(None, leak), (100, three + " " + item)])]
