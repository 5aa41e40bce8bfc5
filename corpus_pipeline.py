"""A training-corpus pipeline over ``documents``: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corroborate.llm import bpe, cuckoo, similar, templates, toxicity
from corroborate.llm.common import checkpointed, table


#: Bytes of a batch that goes to a Python worker and back. By default 64 MB, whose buffers stay with an executor once a stage needed them.
BATCH = 2_000_000


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's size of batches: a stage's plan may run after its function has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def _files_end(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of each action of the session when it ends, not when the driver happens to collect its garbage.

    Steps rest on checkpoints, so no later one reads them.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


# Rules for nulls, empty and long texts, repeated rows, empty tables and further columns are those of the
# operators that the stages call; each stage says what becomes of them.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5, with all their columns; nulls score as empty texts, repeated rows alike, none give none."""
    _small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (nulls are empty and equal), with all its columns; of fully repeated rows one stays."""
    _small_batches(spark)
    return cuckoo.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 0.8 or more on five-word shingles; texts without words all stay, fully repeated rows stay together."""
    _small_batches(spark)
    _files_end(spark)
    return similar.keep_one(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, with all their columns; nulls hold none, repeated rows go or stay together."""
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text again."""
    _small_batches(spark)
    return bpe.encode_checked(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: A trained classifier, SimHash and BPE are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other; what a stage keeps is checkpointed, so the next does not compute it again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
