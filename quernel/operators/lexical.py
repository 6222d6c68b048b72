"""Inverted index and BM25.

Postings carry the length of their passage, so scoring joins nothing but the query's terms, which are
broadcast while they are few. Every entry point takes a batch of queries; one query is a batch of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.text import tokenize
from quernel.runtime import broadcast_if_small, cut, ship_package

K1, B = 1.2, 0.75
DEPTH = 50


def postings(passages: DataFrame) -> DataFrame:
    """term, doc_id, chunk_no, tf, n_tokens. The terms of a passage are counted where it is read, without a shuffle."""
    ship_package(passages.sparkSession)
    rows = passages.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.col("n_tokens").cast("int").alias("n_tokens"), tokenize(F.col("text").cast("string")).alias("terms"))

    def count(batches):
        for batch in batches:
            terms = batch.column(3)
            of, words = pc.list_parent_indices(terms), pc.list_flatten(terms).dictionary_encode()
            if not len(of):
                continue
            kinds = len(words.dictionary)
            cells, tf = np.unique(of.to_numpy().astype(np.int64) * kinds + words.indices.to_numpy(), return_counts=True)
            row = pa.array(cells // kinds)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(cells % kinds)), batch.column(0).take(row), batch.column(1).take(row), pa.array(tf.astype(np.int32)), batch.column(2).take(row)], names=["term", "doc_id", "chunk_no", "tf", "n_tokens"])

    return rows.mapInArrow(count, f"term string, doc_id {passages.schema['doc_id'].dataType.simpleString()}, chunk_no int, tf int, n_tokens int")


def write_postings(passages: DataFrame, path: str, partitions: int) -> None:
    """Postings clustered by term, so that a scan for a few terms skips most row groups."""
    postings(passages).repartitionByRange(partitions, "term", "doc_id").sortWithinPartitions("term", "doc_id", "chunk_no").write.mode("overwrite").parquet(path)


def document_frequency(posting_list: DataFrame) -> DataFrame:
    return posting_list.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(passages: DataFrame) -> DataFrame:
    """One row: n_docs (with passages), n_passages, avg_len."""
    return passages.agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_passages"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("avg_len"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, pos, term: each occurrence counts, also of a word that comes twice."""
    return queries.select("query_id", F.posexplode(tokenize(F.col("text"))).alias("pos", "term"))


def ranked(scored: DataFrame, depth: int, score: str = "score") -> DataFrame:
    """The best rows of each query with their rank from 1: score descending, then doc_id, then chunk_no."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id", "chunk_no")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def bm25(queries: DataFrame, posting_list: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_no, score for every passage that shares a term with a query (query_id, text).

    Contributions are added in the order of the query's words, so equal passages score the same to the last bit. The postings
    in question are dealt by passage once, before each meets the queries that ask for it; the sums need no other shuffle."""
    terms = query_terms(queries)
    asked = broadcast_if_small(terms.select("term").distinct())
    hit = posting_list.join(asked, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_passages") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = broadcast_if_small(cut(weighted.select("query_id", "pos", "term", idf.alias("idf"), "avg_len")))  # the counts are made once
    tf = F.col("tf").cast("double")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.col("avg_len")))
    each = hit.repartition("doc_id", "chunk_no").join(words, "term").select("query_id", "doc_id", "chunk_no", F.struct("pos", part.alias("part")).alias("s"))
    summed = F.aggregate(F.array_sort(F.collect_list("s")), F.lit(0.0), lambda t, x: t + x["part"])
    return each.groupBy("query_id", "doc_id", "chunk_no").agg(summed.alias("score"))
