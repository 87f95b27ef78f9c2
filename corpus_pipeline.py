"""A training corpus from raw documents: filter, deduplicate, decontaminate, redact, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of `documents`.  Decisions take effect: documents the quality
rules reject, near copies other than the one of the smallest id, and documents in which a
benchmark item is found are gone; personal data is replaced in the texts (n_chars follows);
what remains is encoded.  Between stages the rows are written as Parquet to the shared
folder and read again.

Every stage has the session hand over texts a thousand at a time (`small_batches`): Spark's ten
thousand hold tens of megabytes, several times over in every executor.

Edge cases, in every stage: null and empty texts, null and repeated ids, repeated rows, very long
texts, ties, an empty table and extra columns are handled as the stage's operator says; a
null or empty text fails the quality rules, so later stages meet none in a whole run.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from cutline.llm import bpe, decontam, divergence, pii, resemblance, simhash
from cutline.llm.common import read, small_batches
from cutline.plans.stage import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules keep (operator 7)."""
    small_batches(spark)
    return divergence.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, similarity 0.8, and SimHash links (operator 10)."""
    small_batches(spark)
    return simhash.keep_one(docs, join=partial(resemblance.joined, docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found (operator 9)."""
    small_batches(spark)
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind (operator 2)."""
    small_batches(spark)
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of every text (operator 1)."""
    small_batches(spark)
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", redact_pii),
    ("byte_bpe", encode),
]

#: Fingerprints, learned weights and merges are not expressible in SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
