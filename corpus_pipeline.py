"""A training corpus from raw documents: quality, near-dedup, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``. Stages are written as Parquet and
read again, so an executor that is lost costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandforge.llm import decontaminate, mixing, near_copies, quality, secrets
from strandforge.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts alike in 0.8 of their 5-word shingles."""
    return near_copies.one_of_each(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redacted(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken."""
    return mixing.mix_taken(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: Trained dictionaries and XXH64 shingles have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
