"""Encoders: text -> unit vector. One that needs no model, and a client of an embedding server."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.vector import hash_encode
from quernel.functions.text import prefix_pair
from quernel.runtime import ship_package

BATCH = 4
PAUSE = 0.25
QUERY_SECONDS, PASS_SECONDS, PROBE_SECONDS = 3.0, 120.0, 10.0


@dataclass
class HashEncoder:
    """Counts of hashed words, in the JVM; deterministic."""

    dim: int = 64

    @property
    def model(self) -> str:
        return f"hash-fnv1a-{self.dim}"

    def encode(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        return rows.withColumn("vec", hash_encode(F.make_valid_utf8(F.col(text_col).cast("string")), self.dim))

    def encode_query(self, queries: DataFrame) -> DataFrame:
        return self.encode(queries).select("query_id", F.col("vec").alias("qvec"))


class Refused(RuntimeError):
    """The server won't take an input as it is."""


class Transient(RuntimeError):
    """The server failed; the same input may do later."""


def pool(embedding) -> list[float]:
    """A vector, or the mean of vectors of tokens; ragged ones are an error."""
    if embedding and isinstance(embedding[0], list):
        if len({len(v) for v in embedding}) != 1:
            raise Transient("vectors of different lengths")
        return [sum(c) / len(embedding) for c in zip(*embedding)]
    return [float(x) for x in embedding]


def unit(v: list[float]) -> list[float]:
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


@dataclass
class HttpEncoder:
    """Client of a server with /v1/models and /v1/embeddings; probe() fills in model, dim, context and, where none are
    given, the prefixes that go with the model's name."""

    base: str
    query_prefix: str | None = None
    doc_prefix: str | None = None
    model: str = ""
    dim: int = 0
    n_ctx: int = 0
    calls: int = field(default=0, compare=False)

    def _get(self, path: str, body: dict | None = None, seconds: float = PASS_SECONDS) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.base.rstrip("/") + path, data, {"Content-Type": "application/json"})
        self.calls += 1
        try:
            with urllib.request.urlopen(request, timeout=seconds) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            raise (Refused if 400 <= e.code < 500 else Transient)(f"server said {e.code}") from e
        except (OSError, ValueError) as e:
            raise Transient(str(e)) from e

    def server_model(self) -> tuple[str, int]:
        """Name and context of the first model."""
        data = self._get("/v1/models", seconds=PROBE_SECONDS).get("data") or [{}]
        name = data[0].get("id", "").replace("\\", "/").rstrip("/").rpartition("/")[2]
        return (name[:-5] if name.lower().endswith(".gguf") else name), int((data[0].get("meta") or {}).get("n_ctx") or 0)

    def probe(self) -> HttpEncoder:
        self.model, self.n_ctx = self.server_model()
        query, passage = prefix_pair(self.model)
        self.query_prefix = query if self.query_prefix is None else self.query_prefix
        self.doc_prefix = passage if self.doc_prefix is None else self.doc_prefix
        self.dim = len(self._once(["probe"], PROBE_SECONDS)[0])
        return self

    def max_chars(self, prefix: str) -> int:
        return (3 * self.n_ctx if self.n_ctx > 0 else 1536) - len(prefix.encode())

    def _once(self, inputs: list[str], seconds: float) -> list[list[float]]:
        got = self._get("/v1/embeddings", {"input": inputs}, seconds).get("data", [])
        by_place = {d.get("index"): d.get("embedding") for d in got}
        if set(by_place) != set(range(len(inputs))):
            raise Transient("the answer doesn't match the inputs")
        return [unit(pool(by_place[i])) for i in range(len(inputs))]

    def post(self, inputs: list[str], seconds: float = PASS_SECONDS) -> list[list[float]]:
        """Transient failures are tried once more after a pause, refusals never."""
        try:
            return self._once(inputs, seconds)
        except Transient:
            time.sleep(PAUSE)
            return self._once(inputs, seconds)

    def _one(self, text: str) -> list[float] | None:
        """A refused input is halved, twice at most; None if it is refused still. Transient failures go up."""
        for _ in range(3):
            try:
                return self.post([text])[0]
            except Refused:
                text = text[: len(text) // 2]
        return None

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """Vectors of passages, None where the server refuses one."""
        prefix = self.doc_prefix or ""
        most = max(0, self.max_chars(prefix))
        inputs = [prefix + t[:most] for t in texts]
        out: list[list[float] | None] = []
        for i in range(0, len(inputs), BATCH):
            part = inputs[i : i + BATCH]
            try:
                out += self.post(part)
            except Refused:
                out += [self._one(t) for t in part]
        return out

    def embed_query(self, text: str) -> list[float] | None:
        """None if the server doesn't answer in time; the search is lexical then."""
        try:
            prefix = self.query_prefix or ""
            return self._once([prefix + text[: max(0, self.max_chars(prefix))]], QUERY_SECONDS)[0]
        except (Refused, Transient):
            return None

    def encode(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """rows with vec; null where a passage is refused."""
        ship_package(rows.sparkSession)
        at, width = rows.columns.index(text_col), len(rows.columns)
        schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields)] + [f"c{width} array<float>"])

        def run(batches):
            for batch in batches:
                texts = [t.decode("utf-8", "replace") if isinstance(t, bytes) else t or "" for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(self.embed(texts), pa.list_(pa.float32()))], names=[f"c{i}" for i in range(width + 1)])

        return rows.toDF(*[f"c{i}" for i in range(width)]).mapInArrow(run, schema).toDF(*rows.columns, "vec")
