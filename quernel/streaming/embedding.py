"""Keeps the vector cache up to date: new documents arrive as a stream, each batch encodes what is missing.

What is missing is worked out from the tables by anti joins, so a batch that is run again does nothing twice
and a failed one is simply made up for. Many uploads between two triggers are one batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernel.operators.chunking import passages
from quernel.operators.vectors import orphans, pending
from quernel.runtime import cut
from quernel.schemas import SKIPPED
from quernel.sources.store import Documents, Table, Vectors


@dataclass
class Progress:
    ready: bool = False
    working: bool = False
    model: str = ""
    note: str = ""
    embedded: int = 0
    total: int = 0


class Embedding:
    """A worker over a document table, a vector cache and a table of refused passages."""

    def __init__(self, spark: SparkSession, documents: Documents, vectors: Vectors, encoder, skipped_path: str):
        self.spark, self.documents, self.vectors, self.encoder = spark, documents, vectors, encoder
        self.skipped = Table(spark, skipped_path, SKIPPED, "chunk_hash")
        self.progress = Progress()

    def mine(self) -> DataFrame:
        return self.vectors.read().filter(F.col("model") == self.encoder.model)

    def once(self) -> int:
        """Encode every pending passage and sweep vectors of documents that are gone; how many were encoded."""
        p = self.progress
        p.working, p.note = True, ""
        try:
            if hasattr(self.encoder, "probe"):  # another encoder may answer at the same place
                self.encoder.probe()
            p.ready, p.model = True, self.encoder.model
            live = self.documents.read()
            gone = orphans(self.vectors.read(), live.select(F.col("id").alias("doc_id"))).select("doc_id").distinct()
            if not gone.isEmpty():
                self.vectors.delete(gone)
            every = passages(live)
            refused = self.skipped.read().filter(F.col("model") == self.encoder.model)
            todo = cut(self.encoder.encode(pending(every, self.mine(), refused)))
            self.skipped.append(todo.filter("vec IS NULL").select(F.lit(self.encoder.model).alias("model"), "chunk_hash").distinct())
            done = todo.filter("vec IS NOT NULL")
            self.vectors.save(done.select(F.lit(self.encoder.model).alias("model"), "doc_id", "chunk_hash", F.col("vec").cast("array<float>").alias("vec")), self.encoder.dim)
            n, have = done.count(), self.mine().select("chunk_hash").distinct()
            total = every.agg(F.count("*").alias("n")).first()["n"]
            p.total, p.embedded = total, total - every.join(have, "chunk_hash", "left_anti").count()
            return n
        except Exception as e:
            p.ready, p.note = False, str(e)[:300]
            raise
        finally:
            p.working = False

    def start(self, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
        """A stream over newly written documents; without seconds it handles what is there and ends."""
        schema = self.documents.schema + ", written bigint"
        stream = self.spark.readStream.schema(schema).parquet(f"{self.documents.path}/rows").select("id")
        trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
        return stream.writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else self.once()).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def forget(self, doc_ids: DataFrame) -> None:
        self.vectors.delete(doc_ids)

    def forget_all(self) -> int:
        return self.vectors.wipe()
