"""A corpus made ready for training: five stages over ``documents``, each one operator of ledgerline.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import decontamination, language_id, mixing, pii, queries, simhash
from ledgerline.runtime import settle


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without readable text, and those whose language is not recognised, go."""
    return language_id.keep_known(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: one document of each group stays."""
    return simhash.keep_first(docs, shingle=3, distance=2)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold benchmark passages go."""
    return decontamination.keep_uncontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal values in the texts become pseudonyms; ``n_chars`` follows where the length has changed."""
    changed = pii.replace_values(docs, queries.PII_KEY)
    return changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the blocks of the training mix, a row for each document's part of a block."""
    return mixing.mixed_blocks(docs)


STAGES = [
    ("language_id", known_languages),
    ("simhash_near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii_pseudonyms", with_pseudonyms),
    ("mixing", mixed),
]

# Language ID, SimHash, pseudonyms and the mix's draws are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what each one keeps is written and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, f"stage-{name}")
    return docs
