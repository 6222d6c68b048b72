"""Tables that are only appended to, with deletions as a second table, so that writers never rewrite rows.

Reads leave out rows whose key was deleted after they were written; compact() rewrites once many were.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.text import is_blank, new_id, stored_name
from quernel.runtime import broadcast_if_small
from quernel.schemas import DOCUMENTS, MESSAGES, VECTORS
from quernel.sources.extract import MAX_TEXT


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    fs.rename(p, _fs(spark, new)[1])


class Table:
    """Rows under path/rows, deletions (key, at) under path/gone."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.key, self.partition_by = spark, path.rstrip("/"), schema, key, partition_by

    def append(self, rows: DataFrame) -> None:
        rows = rows.withColumn("written", F.lit(time.time_ns()))
        rows.write.mode("append").partitionBy(*self.partition_by).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        """Live rows."""
        if not exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], self.schema)
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows = self.spark.read.schema(self.schema + ", written bigint").parquet(f"{self.path}/rows")
        if not exists(self.spark, f"{self.path}/gone"):
            return rows.select(columns)
        gone = self.spark.read.parquet(f"{self.path}/gone").groupBy("key").agg(F.max("at").alias("at"))
        return rows.join(broadcast_if_small(gone), (F.col(self.key) == F.col("key")) & (F.col("written") <= F.col("at")), "left_anti").select(columns)

    def delete(self, keys: DataFrame) -> None:
        """Delete the rows of keys (one column)."""
        keys.toDF("key").distinct().withColumn("at", F.lit(time.time_ns())).write.mode("append").parquet(f"{self.path}/gone")

    def wipe(self) -> int:
        """Delete everything; how many keys there were."""
        n = self.read().select(self.key).distinct().count()
        remove(self.spark, f"{self.path}/rows")
        remove(self.spark, f"{self.path}/gone")
        return n

    def compact(self) -> None:
        """Rewrite live rows without the deleted ones; the new folder is complete before it takes the old one's place."""
        new = f"{self.path}/rows-{uuid.uuid4().hex}"
        self.read().withColumn("written", F.lit(time.time_ns())).write.partitionBy(*self.partition_by).parquet(new)
        remove(self.spark, f"{self.path}/rows")
        rename(self.spark, new, f"{self.path}/rows")
        remove(self.spark, f"{self.path}/gone")


class Documents(Table):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, DOCUMENTS, "id")

    def add(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Append extracted documents (origin, text); (added, refused with error). Too long or blank texts are refused."""
        size = F.octet_length("text")
        error = F.when(F.col("text").isNull() | is_blank(F.col("text")), "no text in this document").when(size > MAX_TEXT, "larger than a document may be")
        judged = found.select("origin", "text", error.alias("error"))
        # ids are drawn once: the rows are fixed before they are both stored and returned
        from quernel.runtime import cut

        now = F.current_timestamp()
        fresh = judged.filter("error IS NULL").select(new_id(now, F.lower(F.substring(F.expr("uuid()"), 1, 4))).alias("id"), stored_name(F.col("origin")).alias("name"), "origin", size.cast("bigint").alias("bytes"), now.alias("added"), "text")
        fresh = cut(fresh)
        self.append(fresh)
        return fresh, judged.filter("error IS NOT NULL").select("origin", "error")


class Messages(Table):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, MESSAGES, "chat_id")


class Vectors(Table):
    """Vector cache, partitioned by model, so that another model's vectors are never read."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, VECTORS, "doc_id", ("model",))

    def save(self, rows: DataFrame, dim: int) -> None:
        """Append vectors; one of another length is an error."""
        fits = F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.lit("a vector has the wrong length")).cast("array<float>"))
        self.append(rows.select("model", F.lit(dim).alias("dim"), "doc_id", "chunk_hash", fits.alias("vec")))


class Settings:
    """One JSON object, replaced as a whole; unreadable settings are empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> dict:
        try:
            got = json.loads("\n".join(r.value for r in self.spark.read.text(self.path, wholetext=True).take(1)))
        except Exception:  # absent or damaged settings are the defaults
            return {}
        return got if isinstance(got, dict) else {}

    def save(self, settings: dict) -> None:
        self.spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(self.path)
