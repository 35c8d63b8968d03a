"""A corpus pipeline: each stage takes the rows that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontaminate, jaccard, langid, packing, secrets
from docspark.llm.common import stored, table
from docspark.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python, unless the session does so itself.

    By default a batch is 10,000 rows however long their texts are, and the
    executor and each of its workers hold it several times over. The setting
    stays, as a stage's rows are made only when its frame is written.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which no language can be told."""
    small_batches(spark)
    return langid.keep_known(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of copies."""
    small_batches(spark)
    return jaccard.keep_one(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and masks the secrets in its text."""
    small_batches(spark)
    return secrets.mask_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with the sequences they fill."""
    small_batches(spark)
    return packing.pack_documents(spark, docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("known_language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("masked_secrets", masked_secrets),
    ("packed", packed),
]

# Learnt models, connected components and tokenizers are beyond SQL; the
# tests hold the rows against a brute-force run.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written and read again.

    The frame returned holds no Python, so the session's setting is put back.
    """
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH, None)
    try:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        if before is None:
            spark.conf.unset(BATCH)
