"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.decontam import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.store import read_store, store_path, write_store

    path = store_path(spark)
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85, count_links=True)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.pii import BASE, find_pii, listed, of_kind

    spans = find_pii(table(spark, sf_dir, "documents"), keep=("doc_id",)).select("doc_id", "pii")
    counts = [F.size(of_kind(F.col("pii"), k)).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(listed(of_kind(F.col("pii"), *BASE)).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.topk import quantised, top_k

    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.common import Scratch
    from sluice.llm.warc import read_warc, write_warc

    path = Scratch(spark, "warc").path("archives")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.mining import hard_negatives
    from sluice.llm.topk import quantised

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.bpe import decode_ids, encode_texts

    decoded = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    written = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def queries() -> dict:
    every = (op1_jaccard_join, op2_pii, op3_exact_top_k, op4_deleted_interpolation, op5_decontamination, op6_content_store, op7_warc, op8_language_id, op9_importance_resampling, op10_best_fit_packing, op11_hard_negatives, op12_filter_audit, op13_byte_bpe)
    return {f.__name__: f for f in every}


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

WARC_SQL = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT x, least(x, min(y)) FROM e GROUP BY x UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(k.c, w.doc_id)) AS component_id, coalesce(d.n_links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) AS k USING (doc_id)
  LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY 1) AS d USING (doc_id)"""


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
         CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
r AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score WHERE n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10"""

AUDIT_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
w AS (
  SELECT t.*, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
          100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM w JOIN f USING (text) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
c(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
p(o) AS (SELECT '' UNION ALL SELECT p.o || c.c FROM p JOIN c ON NOT contains(p.o, c.c)),
o AS (SELECT o AS filter_order, s AS step, instr('ABCDE', substr(o, s, 1)) AS own,
             list_transform(range(1, s), lambda i: instr('ABCDE', substr(o, i, 1))) AS before
      FROM p, (SELECT unnest(range(1, 6)) AS s) WHERE length(o) = 5),
x AS (SELECT g.*, o.*, fails[own] AS hit, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS k FROM g, o)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (hit AND k = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(k, 1))) FILTER (hit), 0) AS BIGINT) AS shapley
FROM x GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": JACCARD_SQL, "op3_exact_top_k": TOP_K_SQL, "op7_warc": WARC_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_filter_audit": AUDIT_SQL}
