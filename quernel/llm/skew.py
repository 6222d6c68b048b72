"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.runtime import cut

#: Counters of a frequent-items sketch (Misra-Gries family): bounds what is broadcast and the rows of any other key.
COUNTERS = 4096
#: Groups of partitions that have a sketch each; what these find is united afterwards.
MERGE_WAYS = 64


def frequent(rows: DataFrame, key: Column) -> DataFrame:
    """Hashes h of keys that may hold more than about 1 / COUNTERS of the rows: at most COUNTERS rows."""
    part = rows.select(F.xxhash64(key).alias("h"), F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)).alias("way"))
    sketches = part.groupBy("way").agg(F.expr(f"approx_top_k_accumulate(h, {COUNTERS}) AS sketch"))
    found = sketches.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {COUNTERS})")).alias("t"))
    return found.groupBy(F.col("t.item").alias("h")).agg(F.sum("t.count").alias("n")).orderBy(F.desc("n"), "h").limit(COUNTERS).select("h")


def skew_join(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows left joined with side, in which key is unique. The rows of frequent keys are joined where they are read."""
    if rows.isEmpty():
        return rows.join(side, key, "left")
    hot = frequent(rows, F.col(key)).withColumnRenamed("h", "hot_h")
    chosen = cut(side.join(F.broadcast(hot), F.xxhash64(key) == F.col("hot_h"), "left_semi"))
    heavy = rows.join(F.broadcast(chosen), key)
    light = rows.join(F.broadcast(chosen.select(key)), key, "left_anti").join(side, key, "left")
    return heavy.unionByName(light)
