"""Views over the corpus: documents with their passage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def docs_list(docs: DataFrame, passages: DataFrame, id_col: str = "id", added: str = "added") -> DataFrame:
    """Documents without their text, with chunks, the newest first, then by id descending."""
    counts = passages.groupBy(F.col("doc_id").alias(id_col)).agg(F.count("*").alias("chunks"))
    return docs.drop("text").join(counts, id_col, "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))).orderBy(F.desc(added), F.desc(id_col))


def chunks_for(passages: DataFrame, doc_id) -> DataFrame:
    return passages.filter(F.col("doc_id") == doc_id).agg(F.count("*").alias("chunks"))


def doc_ids(passages: DataFrame) -> DataFrame:
    return passages.select("doc_id").distinct().orderBy("doc_id")


def content_classes(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """hash, first_id, copies of each distinct text."""
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
