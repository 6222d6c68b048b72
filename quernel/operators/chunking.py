"""Splitting of texts into overlapping passages, by bytes.

Blank lines separate paragraphs. Paragraphs are gathered up to TARGET bytes; a passage that closes lends its
last OVERLAP bytes to the next one. A paragraph of more than twice the target is cut hard, every TARGET -
OVERLAP bytes. Passages are trimmed; cuts may fall inside a character, so passages are binary.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.runtime import ship_package

TARGET, OVERLAP = 1000, 150
STRIDE = TARGET - OVERLAP


# UTF-8 of the characters with the White_Space property.
_WHITE = rb"(?:[\t-\r ]|\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80)"
_HEAD, _TAIL = re.compile(rb"\A" + _WHITE + rb"+"), re.compile(_WHITE + rb"\Z")


def trimmed(b: bytes) -> bytes:
    """Without white space at either end; the bytes of a character that a cut has split are kept."""
    b = _HEAD.sub(b"", b)
    while m := _TAIL.search(b, max(0, len(b) - 3)):
        b = b[: m.start()]
    return b


def paragraphs(text: Column) -> Column:
    """Texts between blank lines; the lines of one are joined by \\n."""
    lines = F.regexp_replace(text, r"\r(?=\n|\z)", "")
    parts = F.split(F.concat(F.lit("\n\n"), lines, F.lit("\n\n")), r"\n\p{IsWhite_Space}*\n", -1)
    return F.filter(parts, lambda p: p != "")


def hard_cuts(size: Column) -> Column:
    """How many pieces are cut off a paragraph of this size."""
    return F.when(size <= 2 * TARGET, 0).otherwise(F.ceil((size - 2 * TARGET) / STRIDE)).cast("int")


def offsets(size: Column) -> Column:
    """(start, length) of the passages of a text of one paragraph, before they are trimmed."""
    n = hard_cuts(size)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((i * STRIDE).alias("start"), F.when(i < n, F.lit(TARGET)).otherwise(size - n * STRIDE).cast("int").alias("length")))


def gather(parts: list[bytes]) -> list[bytes]:
    """Passages of a text that has these paragraphs."""
    out: list[bytes] = []
    held: list[bytes] = []  # pieces of the passage that is open
    size = 0

    def close() -> None:
        nonlocal held, size
        if got := trimmed(b"".join(held)):
            out.append(got)
        held, size = [], 0

    def put(piece: bytes) -> None:
        nonlocal size
        held.append(piece)
        size += len(piece)

    for part in parts:
        cuts = -(-(len(part) - 2 * TARGET) // STRIDE)
        if cuts > 0:
            close()
            out += [trimmed(part[i * STRIDE : i * STRIDE + TARGET]) for i in range(cuts)]
            part = part[cuts * STRIDE :]
        if size and size + len(part) > TARGET:
            tail = b"".join(held)[-OVERLAP:] if size > OVERLAP else b""
            close()
            if tail:
                put(tail + b"\n")
        if size:
            put(b"\n\n")
        put(part)
    close()
    return out


@cache
def _gathered():
    """The fold over paragraphs, a batch at a time: its state grows with the text, which no built-in keeps without copying it."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else gather(x) for x in column.cast(pa.list_(pa.binary())).to_pylist()], pa.list_(pa.binary()))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<binary>")


def chunk(text: Column) -> Column:
    """Passages of a text, array<binary>."""
    return _gathered()(paragraphs(text))


def chunk_hash(passage: Column) -> Column:
    """First 16 bytes of the SHA-256 of a passage, in hexadecimal."""
    return F.substring(F.sha2(passage.cast("binary"), 256), 1, 32)


def passages(docs: DataFrame, id_col: str = "id", name_col: str = "name", text_col: str = "text") -> DataFrame:
    """doc_id, doc_name, chunk_no (from 0), text, n_tokens, chunk_hash."""
    from quernel.functions.text import tokenize

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(name_col).cast("string").alias("doc_name"), F.posexplode(chunk(F.coalesce(F.col(text_col), F.lit("")))).alias("chunk_no", "text"))
    return rows.select("doc_id", "doc_name", F.col("chunk_no").cast("int").alias("chunk_no"), "text", F.size(tokenize(F.col("text").cast("string"))).alias("n_tokens"), chunk_hash(F.col("text")).alias("chunk_hash"))
