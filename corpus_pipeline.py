"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes what the one before kept and returns the columns of documents (the last: ids' digests).
Defined results: a row is a document, whatever its id, and of each group of near-duplicates exactly one row
stays: that of the smallest id, null last; rows of one id are ordered by a digest of all their columns, so
the choice does not depend on partitions or lost executors. Null, blank and letterless texts go in the first
stage. Where no document has a language to learn from, texts with letters stay. Extra columns are passed
through with their values, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, langid, queries, secrets, simhash
from corvane.llm.common import bounded_batches, free_name, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which nothing can be labelled: null texts and texts without a letter have no span."""
    bounded_batches(spark)
    language = free_name(docs, "language")
    found = langid.identify(docs, langid.fit(langid.labelled_documents(docs)), into=language)
    return found.where(F.size(f"{language}.spans") > 0).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    bounded_batches(spark)
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    bounded_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean(docs, items)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    spans = free_name(docs, "secrets")
    found = secrets.masked(secrets.scan(docs, into=spans), spans=spans)
    changed = F.size(spans) > 0
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts: doc_id, n_tokens, and digests of ids and decoded bytes."""
    bounded_batches(spark)
    return bpe.digests(docs, queries.MULTI_RANKS)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("byte-level BPE", encode),
]

#: Fingerprints, language models and BPE are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
