"""A training corpus from raw documents: five stages, each a whole-table operator.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last returns
the order in which documents are read for training.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, language_id, mixing, near_copies, secret_scan, simhash
from panelwright.llm.common import Written, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go."""
    return language_id.keep_identified(docs, language_id.fit(docs.where(~language_id.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8) stays, that with the smallest id."""
    return simhash.drop_near_duplicates(docs, classify=near_copies.similar_classes, width=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a twentieth or more of benchmark words go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed as evenly as four readings of a document allow, in blocks of a million words."""
    return mixing.mix(docs, mixing.word_tokens(), repetition=4.0, block_tokens=1_000_000)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("temperature_mix", mix_sources),
]
#: SQL cannot express trees of probabilities or 64-bit hashing of shingles; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result but the last written to the shared folder and read again.

    A stage's table is removed once the next one is written; the last one stays, as the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        written = Written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.remove()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
