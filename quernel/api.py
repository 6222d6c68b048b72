"""One method for each thing a client can ask: documents, search, conversations, settings, health."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import chats as chat_views
from quernel.operators.chunking import passages
from quernel.operators.corpus import docs_list
from quernel.operators.dense import MIN_Z, baseline, strided_sample
from quernel.operators.hybrid import grounding, hits, parse_k, search_batch, sources
from quernel.operators.lexical import corpus_stats, postings
from quernel.operators.vectors import attach, valid_vectors, vec_stats
from quernel.schemas import CHATS
from quernel.sources.encoder import HashEncoder
from quernel.sources.extract import extract_files
from quernel.sources.store import Documents, Messages, Settings, Table, Vectors, remove
from quernel.streaming.embedding import Embedding


class Engine:
    """Tables under one folder. Search reads an index that reindex() writes; it is lexical until vectors exist."""

    def __init__(self, spark: SparkSession, path: str, encoder=None, min_z: float = MIN_Z, chats: bool = True, partitions: int = 8):
        path = path.rstrip("/")
        self.spark, self.path, self.min_z, self.partitions, self.has_chats = spark, path, min_z, partitions, chats
        self.encoder = encoder or HashEncoder()
        self.documents, self.vectors = Documents(spark, f"{path}/documents"), Vectors(spark, f"{path}/vectors")
        self.chats_, self.messages = Table(spark, f"{path}/chats", CHATS, "id"), Messages(spark, f"{path}/messages")
        self.settings_ = Settings(spark, f"{path}/settings")
        self.worker = Embedding(spark, self.documents, self.vectors, self.encoder, f"{path}/skipped")
        self.index: str | None = None
        self.reindex()

    # documents

    def reindex(self) -> None:
        """Passages and postings as a new version; the old one goes when the new one is whole."""
        new, old = f"{self.path}/index-{uuid.uuid4().hex}", self.index
        passages(self.documents.read()).write.parquet(f"{new}/passages")
        cut = self.spark.read.parquet(f"{new}/passages")
        postings(cut).repartitionByRange(self.partitions, "term", "doc_id").sortWithinPartitions("term", "doc_id", "chunk_no").write.parquet(f"{new}/postings")
        self.index = new
        if old:
            remove(self.spark, old)

    def passages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.index}/passages")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.index}/postings")

    def list_docs(self) -> DataFrame:
        return docs_list(self.documents.read(), self.passages())

    def get_doc(self, doc_id: str) -> DataFrame:
        return self.documents.read().filter(F.col("id") == doc_id)

    def add_files(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(added with chunks, refused with error) for files (path, content); some of an archive may be refused."""
        found = extract_files(files)
        added, refused = self.documents.add(found.filter("error IS NULL").select("origin", "text"))
        self.reindex()
        return docs_list(added, self.passages()), refused.unionByName(found.filter("error IS NOT NULL").select("origin", "error"))

    def delete_doc(self, doc_id: str) -> None:
        key = self.spark.createDataFrame([(doc_id,)], "key string")
        self.documents.delete(key)
        self.worker.forget(key)
        self.reindex()

    def wipe_docs(self) -> int:
        n = self.documents.wipe()
        self.worker.forget_all()
        self.reindex()
        return n

    # search

    def embedded(self) -> DataFrame:
        cache = valid_vectors(self.vectors.read(), self.encoder.model, self.encoder.dim or None)
        return attach(self.passages(), cache)

    def search(self, query: str, k=None) -> DataFrame:
        return self.search_batch(self.spark.createDataFrame([("q", query)], "query_id string, text string"), k).drop("query_id")

    def search_batch(self, queries: DataFrame, k=None) -> DataFrame:
        """Hits for queries (query_id, text), best first."""
        have = self.embedded().filter("vec IS NOT NULL")
        vectors = None
        if not have.isEmpty():
            if hasattr(self.encoder, "embed_query"):
                got = [(r["query_id"], self.encoder.embed_query(r["text"])) for r in queries.collect()]  # a client's batch
                told = [g for g in got if g[1] is not None]
                vectors = self.spark.createDataFrame(told, "query_id string, qvec array<double>") if told else None
            else:
                vectors = self.encoder.encode_query(queries)
        dim = self.encoder.dim or None
        base = None if vectors is None else baseline(strided_sample(have), dim)
        found = search_batch(queries, self.postings(), corpus_stats(self.passages()), parse_k(k), vectors, None if vectors is None else have, base, dim, self.min_z)
        return hits(found, self.passages()).orderBy("query_id", "rank")

    def grounding(self, query: str, k=None) -> tuple[str, list[str]]:
        """The hits as a numbered block for a model, and the documents they are from."""
        found = self.search(query, k).withColumn("query_id", F.lit("q"))
        block, names = grounding(found).first(), sources(found).first()
        return (block["block"] if block else ""), (names["sources"] if names else [])

    # conversations

    def _chats(self) -> None:
        if not self.has_chats:
            raise RuntimeError("conversations have no storage here")

    def create_chat(self, model: str | None = None) -> str:
        self._chats()
        now = datetime.now(timezone.utc)
        chat_id = f"{now:%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:4]}"
        self.chats_.append(self.spark.createDataFrame([(chat_id, 1, model, now)], CHATS))
        return chat_id

    def append(self, chat_id: str, role: str, content: str, sources_: list[str] | None = None) -> None:
        self._chats()
        if not role:
            raise ValueError("a message has a role")
        last = self.messages.read().filter(F.col("chat_id") == chat_id).agg(F.max("pos").alias("p")).first()["p"]
        self.messages.append(self.spark.createDataFrame([(chat_id, (last or 0) + 1, role, content, datetime.now(timezone.utc), sources_)], self.messages.schema))

    def list_chats(self) -> DataFrame:
        self._chats()
        messages = self.messages.read()
        last = messages.groupBy(F.col("chat_id").alias("id")).agg(F.max("ts").alias("last"))
        chats = self.chats_.read().join(last, "id", "left").withColumn("updated", F.coalesce("last", "created"))
        return chat_views.metas(chats, messages)

    def get_chat(self, chat_id: str) -> DataFrame:
        self._chats()
        return chat_views.with_messages(self.chats_.read(), self.messages.read(), chat_id)

    def drop_last(self, chat_id: str) -> None:
        """Rewrites one conversation without its last message."""
        self._chats()
        mine = self.messages.read().filter(F.col("chat_id") == chat_id)
        kept = chat_views.drop_last(mine).collect()  # one conversation
        self.messages.delete(self.spark.createDataFrame([(chat_id,)], "key string"))
        if kept:
            self.messages.append(self.spark.createDataFrame(kept, self.messages.schema))

    def delete_chat(self, chat_id: str) -> None:
        self._chats()
        key = self.spark.createDataFrame([(chat_id,)], "key string")
        self.chats_.delete(key)
        self.messages.delete(key)

    def wipe_chats(self) -> int:
        self._chats()
        self.messages.wipe()
        return self.chats_.wipe()

    # the rest

    def settings(self) -> dict:
        return self.settings_.read()

    def save_settings(self, settings: dict) -> None:
        self.settings_.save(settings)

    def health(self) -> DataFrame:
        """One row: docs, passages, embedded, model, ready, note."""
        p = self.worker.progress
        docs = self.documents.read().agg(F.count("*").alias("docs"))
        return docs.crossJoin(vec_stats(self.embedded())).select("docs", F.col("total").alias("passages"), "embedded", F.lit(self.encoder.model).alias("model"), F.lit(p.ready).alias("ready"), F.lit(p.note).alias("note"))

    def as_json(self, rows: DataFrame) -> str:
        """An answer of bounded size (hits, lists of one client) as JSON."""
        return "[" + ",".join(rows.toJSON().collect()) + "]" if rows.columns else json.dumps([])
