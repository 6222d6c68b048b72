"""Exhaustive vector scoring with a floor that the corpus itself sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.vector import dot
from quernel.operators.lexical import DEPTH, ranked
from quernel.runtime import cut

SAMPLE, PAIRS, GAP = 96, 20, 4
MIN_Z = 2.0
SAME = 1e-12


def strided_sample(embedded: DataFrame, size: int = SAMPLE) -> DataFrame:
    """i, doc_id, chunk_no, vec of at most `size` embedded passages, evenly spaced in corpus order.

    Ranks come from counts by document, so that no task numbers the corpus row by row."""
    docs = embedded.groupBy("doc_id").agg(F.count("*").alias("n"))
    parts = embedded.sparkSession.sparkContext.defaultParallelism
    docs = cut(docs.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = docs.groupBy("part").agg(F.sum("n").alias("n")).select("part", earlier(Window.orderBy("part")).alias("offset"))  # one row for each part
    before = docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + earlier(Window.partitionBy("part").orderBy("doc_id"))).alias("before"))
    total = F.broadcast(docs.agg(F.sum("n").alias("m")))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no")) - 1 + F.col("before")
    step = F.greatest(F.lit(1), F.floor(F.col("m") / size))
    numbered = embedded.join(before, "doc_id").withColumn("at", at).crossJoin(total).withColumn("step", step)
    return numbered.filter((F.col("at") % F.col("step") == 0) & (F.floor(F.col("at") / F.col("step")) < size)).select(F.floor(F.col("at") / F.col("step")).alias("i"), "doc_id", "chunk_no", "vec")


def baseline(sample: DataFrame, dim: int | None = None) -> DataFrame:
    """One row (mean, sd, pairs) of the cosines of sampled passages of different documents; zeros below PAIRS pairs.

    In a corpus of one document, pairs are passages at least GAP apart in the sample."""
    many = F.broadcast(sample.agg((F.countDistinct("doc_id") > 1).alias("many")))
    a = sample.select(F.col("i").alias("a"), F.col("doc_id").alias("da"), F.col("vec").alias("va"))
    b = sample.select(F.col("i").alias("b"), F.col("doc_id").alias("db"), F.col("vec").alias("vb"))
    pairs = F.broadcast(a).join(b, F.col("a") < F.col("b")).crossJoin(many).filter((F.col("many") & (F.col("da") != F.col("db"))) | (~F.col("many") & (F.col("b") - F.col("a") >= GAP)))
    got = pairs.select(dot(F.col("va"), F.col("vb"), dim).alias("cos")).agg(F.avg("cos").alias("mean"), F.stddev_pop("cos").alias("sd"), F.count("*").alias("pairs"))
    enough = F.col("pairs") >= PAIRS
    return got.select(F.when(enough, F.col("mean")).otherwise(0.0).alias("mean"), F.when(enough, F.col("sd")).otherwise(0.0).alias("sd"), F.when(enough, F.col("pairs")).otherwise(0).cast("long").alias("pairs"))


def cosines(queries: DataFrame, embedded: DataFrame, dim: int | None = None) -> DataFrame:
    """query_id, doc_id, chunk_no, cosine for each query vector (query_id, qvec) against each embedded passage.

    The batch of queries is the stated, small side; passages stay where they are."""
    return embedded.crossJoin(F.broadcast(queries.select("query_id", "qvec"))).select("query_id", "doc_id", "chunk_no", dot(F.col("vec"), F.col("qvec"), dim).alias("cosine"))


def spread(scored: DataFrame) -> DataFrame:
    """query_id, mean, variance (population) of all cosines of a query."""
    return scored.groupBy("query_id").agg(F.avg("cosine").alias("q_mean"), F.var_pop("cosine").alias("q_var"))


def dense(queries: DataFrame, embedded: DataFrame, base: DataFrame, dim: int | None = None, min_z: float = MIN_Z, depth: int = DEPTH) -> DataFrame:
    """query_id, doc_id, chunk_no, cosine, rank of the passages above the floor.

    A query to which all passages are the same distance has no results; so has one whose vector has another
    length than the corpus (its cosines are all 0)."""
    scored = cosines(queries, embedded, dim)
    told = F.broadcast(spread(scored).filter(F.col("q_var") >= SAME).select("query_id"))
    floor = F.when((F.col("pairs") >= PAIRS) & (F.col("sd") > 1e-6), F.col("mean") + min_z * F.col("sd")).otherwise(float("-inf"))
    kept = scored.join(told, "query_id").crossJoin(F.broadcast(base.select(floor.alias("floor")))).filter(F.col("cosine") >= F.col("floor"))
    return ranked(kept.drop("floor"), depth, "cosine")
