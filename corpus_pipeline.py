"""Five stages that turn documents into clean, deduplicated, decontaminated, tokenised documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import bpe, decontaminate, exact_dedup, simhash, site_quality
from quernel.runtime import Stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier rejects go."""
    return site_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts one row stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 by similarity: of texts linked by 0.8 of their five-word shingles the document of least id stays."""
    return simhash.keep_least_similar(docs, words=5)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that leak a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token counts and digests of ids and decoded bytes, beside the columns of documents."""
    return bpe.token_digests(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("decontaminate", leaks), ("bpe", tokens)]

#: SQL can express neither the fitted classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each read from where the one before was written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stored = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        docs, before = stored.read(), stored
    return STAGES[-1][1](spark, docs, sf_dir)
