"""Reciprocal rank fusion of the lexical and the dense list, a cap on hits of one document, and search itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.dense import MIN_Z, dense
from quernel.operators.lexical import DEPTH, bm25, ranked

RRF_K = 60
PER_DOC = 2
DEFAULT_K, MAX_K = 4, 20


def parse_k(k) -> int:
    """A count from 1 to 20, else 4."""
    try:
        k = int(str(k))
    except ValueError:
        return DEFAULT_K
    return k if 1 <= k <= MAX_K else DEFAULT_K


def fuse(lexical: DataFrame, semantic: DataFrame | None) -> DataFrame:
    """query_id, doc_id, chunk_no, fused, via, cosine from two ranked lists."""
    key = ["query_id", "doc_id", "chunk_no"]
    left = lexical.select(*key, F.col("rank").alias("lex_rank"))
    if semantic is None:
        both = left.withColumn("sem_rank", F.lit(None).cast("int")).withColumn("cosine", F.lit(None).cast("double"))
    else:
        both = left.join(semantic.select(*key, F.col("rank").alias("sem_rank"), "cosine"), key, "full")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    via = F.when(F.col("lex_rank").isNotNull() & F.col("sem_rank").isNotNull(), "both").when(F.col("lex_rank").isNotNull(), "lexical").otherwise("semantic")
    return both.select(*key, (part("lex_rank") + part("sem_rank")).alias("fused"), via.alias("via"), "cosine")


def cap(fused: DataFrame, k: int, per_doc: int = PER_DOC, score: str = "fused") -> DataFrame:
    """The best k rows of each query with at most per_doc of a document, with their rank from 1."""
    within = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(score), "chunk_no")
    return ranked(fused.withColumn("n_doc", F.row_number().over(within)).filter(F.col("n_doc") <= per_doc).drop("n_doc"), k, score)


def search_batch(queries: DataFrame, posting_list: DataFrame, stats: DataFrame, k: int = DEFAULT_K, vectors: DataFrame | None = None, embedded: DataFrame | None = None, base: DataFrame | None = None, dim: int | None = None, min_z: float = MIN_Z) -> DataFrame:
    """query_id, rank, doc_id, chunk_no, score, via, cosine. vectors (query_id, qvec) and embedded may be absent: lexical only."""
    lexical = ranked(bm25(queries, posting_list, stats), DEPTH)
    semantic = None if vectors is None or embedded is None or base is None else dense(vectors, embedded, base, dim, min_z)
    return cap(fuse(lexical, semantic), k).select("query_id", "rank", "doc_id", "chunk_no", F.col("fused").alias("score"), "via", "cosine")


def hits(found: DataFrame, passages: DataFrame) -> DataFrame:
    """Search results with doc_name and text; the results are the small side."""
    return F.broadcast(found).join(passages.select("doc_id", "chunk_no", "doc_name", F.make_valid_utf8(F.col("text").cast("string")).alias("text")), ["doc_id", "chunk_no"]).select("query_id", "rank", "doc_id", "doc_name", "chunk_no", "text", "score", "via", "cosine")


def grounding(found: DataFrame) -> DataFrame:
    """query_id, block: the hits as numbered sources, in order, a blank line between them."""
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("doc_name"), F.lit("\n"), F.col("text")).alias("line"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("block"))


def sources(found: DataFrame) -> DataFrame:
    """query_id, sources: names of the documents hit, in order of their best hit."""
    best = found.groupBy("query_id", "doc_name").agg(F.min("rank").alias("rank"))
    return best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_name"))), lambda x: x["doc_name"]).alias("sources"))
