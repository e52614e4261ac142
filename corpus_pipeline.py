"""Corpus preparation as stages that each call one operator; every stage works on all its predecessor kept.

Stages but the last return the columns of documents; the last returns the packing of what remains. A row stays or goes
by its own text, also where its id is null or repeats with another text. Empty tables give empty ones; columns beside
those of documents are dropped, whatever their names; texts are taken whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, shared_dir
from sluice.llm.decontam import find_contamination
from sluice.llm.jaccard import near_duplicates
from sluice.llm.langid import UNDETERMINED, identify
from sluice.llm.packing import pack_documents
from sluice.llm.pii import find_pii, redact

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of its letters that a document's language must label.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language, or without one that labels half of their letters, go.

    Null, empty and letterless texts go. Rows with a null id are judged like any (the model learns nothing from them);
    rows with equal texts stay or go together, since texts are known by their 64-bit hash. Of languages that label as
    many letters the first by name counts.
    """
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    found = identify(hashed, carry=("hash",)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select("row.hash").distinct()
    return hashed.join(found, "hash", "left_semi").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, once.

    Groups are components of links between sets of five-word shingles with a similarity of 0.8 or more, so a near copy
    below that stays. Rows without words have no shingle, link with nothing and stay; of repeated rows one stays. Rows with a null id link with nothing and stay. Different texts of one id are documents of their own; all but one
    of them (that with the least hash) rank behind every id.
    """
    named, key = keyed(spark, docs.where("doc_id IS NOT NULL"))
    kept = near_duplicates(named, size=5, percent=80, id_col=key).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = named.join(kept, key, "left_semi").dropDuplicates([key]).select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def keyed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, and the column that tells their texts apart: the id, or a new key where ids repeat with other texts."""
    scratch, texts = Scratch(spark, "keys"), docs.select("doc_id", F.xxhash64("text").alias("hash"))
    several = texts.groupBy("doc_id").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least <> most")
    several = scratch.table(several.select("doc_id", "least"), "several")
    if several.isEmpty():
        return docs, "doc_id"
    others = texts.join(several, "doc_id").where("hash <> least").select("doc_id", "hash").distinct()
    last = docs.agg(F.max("doc_id")).first()[0]
    others = scratch.table(others.withColumn("other", F.lit(last) + 1 + F.monotonically_increasing_id()), "others")
    named = docs.withColumn("hash", F.xxhash64("text")).join(others, ["doc_id", "hash"], "left")
    return named.withColumn("key", F.coalesce("other", "doc_id")), "key"


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.

    Rows with equal texts stay or go together, whatever their ids, null ones included, since texts are known by their
    64-bit hash; null and empty texts stay, as does all where the benchmark is empty.
    """
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    found = find_contamination(hashed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="hash").select(F.col("doc_id").alias("hash")).distinct()
    return hashed.join(found, "hash", "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every row stays.

    Null texts become empty ones. Overlapping spans become one, named by the first; n_chars is counted anew.
    """
    found = find_pii(docs, keep=("doc_id", "lang", "source"))
    text = redact(F.col("whole_text"), F.col("pii"))
    return found.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens in as few sequences as the plan finds.

    Null and empty texts are the end id alone; null ids are kept, and repeated rows are packed each by itself.
    """
    return pack_documents(docs, frugal=True)  # by now the JVM of an executor holds its whole heap


STAGES = [("language_id", language_id), ("near_duplicate", near_duplicate), ("decontaminate", decontaminate), ("pii", pii), ("pack", pack)]
#: Language identification, tokenization and packing are no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs, where = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/sluice/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
