"""The content-addressed vector cache as joins: a vector belongs to a passage's text, not to its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.vector import is_finite


def valid_vectors(cache: DataFrame, model: str, dim: int | None = None) -> DataFrame:
    """Vectors of one model; a document with any vector of wrong length or with a NaN or infinite component is left out whole."""
    mine = cache.filter(F.col("model") == model)
    fits = (F.size("vec") == F.col("dim")) & (F.col("dim") > 0) & is_finite(F.col("vec"))
    if dim is not None:
        fits = fits & (F.col("dim") == dim)
    good = mine.groupBy("doc_id").agg(F.bool_and(fits).alias("good")).filter("good").select("doc_id")
    return mine.join(good, "doc_id", "left_semi")


def attach(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """passages with vec, null where none is cached. One vector serves all passages with the same text."""
    one = vectors.groupBy("chunk_hash").agg(F.min_by("vec", "doc_id").alias("vec"))
    return passages.join(one, "chunk_hash", "left")


def pending(passages: DataFrame, vectors: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """doc_id, chunk_hash, text: distinct passages without a vector that weren't refused before."""
    lost = passages.join(vectors.select("chunk_hash"), "chunk_hash", "left_anti")
    if skipped is not None:
        lost = lost.join(skipped.select("chunk_hash"), "chunk_hash", "left_anti")
    first = F.min(F.struct("chunk_no", "text")).alias("f")
    return lost.groupBy("doc_id", "chunk_hash").agg(first).select("doc_id", "chunk_hash", F.col("f.text").alias("text"), F.col("f.chunk_no").alias("chunk_no"))


def orphans(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors of documents that are gone. documents: column doc_id."""
    return vectors.join(documents.select("doc_id"), "doc_id", "left_anti")


def sweep(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors of live documents."""
    return vectors.join(documents.select("doc_id"), "doc_id", "left_semi")


def vec_stats(attached: DataFrame) -> DataFrame:
    return attached.agg(F.count_if(F.col("vec").isNotNull()).alias("embedded"), F.count("*").alias("total"))


def vectors_for(attached: DataFrame, doc_id) -> DataFrame:
    """chunk_hash, vec of one document."""
    return attached.filter((F.col("doc_id") == doc_id) & F.col("vec").isNotNull()).select("chunk_hash", "vec").dropDuplicates(["chunk_hash"])


def mean_pool(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """key, vec: mean of the vectors of a key by component; an error where lengths differ. Sums are exact partial aggregates."""
    ragged = rows.groupBy(key).agg((F.min(F.size(vec)) != F.max(F.size(vec))).alias("ragged"))
    each = rows.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pooled = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    checked = F.when(F.col("ragged"), F.raise_error(F.lit("vectors of different lengths can't be pooled")).cast("array<double>")).otherwise(F.col("vec"))
    return pooled.join(ragged, key).select(key, checked.alias("vec"))
