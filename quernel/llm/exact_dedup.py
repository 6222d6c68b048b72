"""Exact dedup with a heavy-hitter split (native DataFrame functions only).

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Of
equal texts the row with the most code points in its original text stays, then the smallest doc_id.

A frequent-items sketch of the Misra-Gries family finds the digests that may be frequent. Their exact
counts and winners are computed by a grouped aggregation with map-side combining, and these verified
winners (at most skew.COUNTERS rows) are broadcast: rows of frequent digests are decided where they are read
and never shuffled. All other digests have at most about n / skew.COUNTERS rows each and are shuffled once.

Defined cases: a null text counts as empty; a null doc_id is larger than any other; of rows that agree
in everything one stays; an empty table gives an empty result; columns besides the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.skew import frequent
from quernel.runtime import broadcast_if_small, cut, fresh


def digest(text):
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""), 256))


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row for each document: id, code points, digest and a row number that is fixed from here on."""
    text = F.col(text_col)
    return cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n"),
            digest(text).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )


def _best():
    return F.min(F.struct((-F.col("n")).alias("neg"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))


def decide(rows: DataFrame) -> DataFrame:
    """rows of narrow() with best (the winner) and size (of the group)."""
    if rows.isEmpty():
        return rows.withColumn("best", F.struct((-F.col("n")).alias("neg"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).withColumn("size", F.lit(0).cast("long"))
    maybe = rows.join(F.broadcast(frequent(rows, F.col("digest")).withColumnRenamed("h", "h_")), F.xxhash64("digest") == F.col("h_"), "left_semi")
    winners = cut(maybe.groupBy("digest").agg(_best().alias("best"), F.count("*").alias("size")).filter("size > 1"))
    heavy = rows.join(F.broadcast(winners), "digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    light = light.withColumn("best", _best().over(group)).withColumn("size", F.count("*").over(group))
    return heavy.unionByName(light)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    return decide(narrow(docs, id_col, text_col)).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; same columns. Texts are not shuffled while the list of dropped rows is small."""
    got = cut(decide(narrow(docs, id_col, text_col)).filter("size > 1").select("doc_id", "digest", (F.col("rid") == F.col("best.rid")).alias("kept")))
    key = ["doc_id", "digest"]
    each = got.groupBy(*key).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    lost = each.filter(~F.col("kept"))
    again = each.filter("kept AND rows > 1")
    d, i, g = fresh(docs, "q_digest"), fresh(docs, "q_id"), fresh(docs, "q_of")
    named = lambda x: x.select(F.col("doc_id").alias(i), F.col("digest").alias(g))
    on = lambda: F.col(id_col).eqNullSafe(F.col(i)) & (F.col(d) == F.col(g))
    full = docs.withColumn(d, digest(F.col(text_col)))
    out = full.join(broadcast_if_small(named(lost)), on(), "left_anti")
    if not again.isEmpty():  # rows that agree in id and text: one of them stays
        side = broadcast_if_small(named(again))
        out = out.join(side, on(), "left_anti").unionByName(out.join(side, on(), "left_semi").dropDuplicates([id_col, d]))
    return out.drop(d)
