"""Scans of the engine's own file formats, tolerant of what a crash leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.text import is_blank, valid_id


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).withColumn("stem", stem).filter(valid_id(F.col("stem")))


def read_doc_files(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """documents from *.doc files: a JSON header line, then the text. Files without a header are skipped."""
    files = _files(spark, path, f"{doc_id or '*'}.doc").withColumn("all", F.col("content").cast("string"))
    cut = F.instr("all", "\n")
    head = F.try_parse_json(F.expr("substring(all, 1, instr(all, '\n') - 1)"))
    rows = files.filter(cut > 0).select("stem", head.alias("h"), F.expr("substring(all, instr(all, '\n') + 1)").alias("text"))
    get = lambda k, t: F.try_variant_get("h", f"$.{k}", t)
    return rows.filter(get("id", "string").isNotNull()).select(get("id", "string").alias("id"), get("name", "string").alias("name"), get("name", "string").alias("origin"), get("bytes", "bigint").alias("bytes"), F.try_to_timestamp(get("added", "string")).alias("added"), "text")


def _kind(field: str):
    return F.schema_of_variant(F.variant_get("j", f"$.{field}", "variant"))


def read_chat_files(spark: SparkSession, path: str, chat_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chats, messages) from *.jsonl files.

    See parse_chats."""
    return parse_chats(_files(spark, path, f"{chat_id or '*'}.jsonl").select("stem", F.col("modificationTime").alias("updated"), F.col("content").cast("string").alias("all")))


def parse_chats(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chats, messages) from the text of files (stem, updated, all).

    A last line without its line end is dropped, blank and malformed lines are skipped; the first line that
    isn't blank is the header if it has v > 0, else a message like the others; a message has a role."""
    whole = F.expr("left(all, length(all) - length(substring_index(all, '\n', -1)))")
    lines = files.select("stem", "updated", F.posexplode(F.filter(F.split(whole, "\n"), lambda x: ~is_blank(x))).alias("at", "line")).withColumn("j", F.try_parse_json("line"))
    get = lambda k, t: F.try_variant_get("j", f"$.{k}", t)
    is_header = (F.col("at") == 0) & (F.coalesce(get("v", "int"), F.lit(0)) > 0)
    chats = lines.filter(is_header).select(F.col("stem").alias("id"), get("v", "int").alias("v"), get("model", "string").alias("model"), F.try_to_timestamp(get("created", "string")).alias("created"), "updated")
    text_or_none = lambda k: F.coalesce(_kind(k), F.lit("VOID")).isin("STRING", "VOID")
    sound = (F.coalesce(_kind("role"), F.lit("")) == "STRING") & (get("role", "string") != "") & text_or_none("content") & text_or_none("ts")
    rows = lines.filter(~is_header & F.coalesce(sound, F.lit(False)))
    messages = rows.select(F.col("stem").alias("chat_id"), F.col("at").alias("pos"), get("role", "string").alias("role"), F.coalesce(get("content", "string"), F.lit("")).alias("content"), F.try_to_timestamp(get("ts", "string")).alias("ts"), F.try_variant_get("j", "$.sources", "array<string>").alias("sources"))
    bare = files.select(F.col("stem").alias("id"), "updated").join(chats.select("id"), "id", "left_anti")
    return chats.unionByName(bare.select("id", F.lit(0).alias("v"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("timestamp").alias("created"), "updated")), messages


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a lock file; see parse_lock."""
    return parse_lock(spark.read.text(path))


def parse_lock(lines: DataFrame) -> DataFrame:
    """Rows of a lock file's lines (value): kind, repo, rev, file, bytes, sha256, profile; other kinds leave columns null.

    Kinds: model and embed have all fields, binary has file, bytes, sha256; release has repo (tag in rev)."""
    p = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(p, F.lit(i))
    full, binary = at(0).isin("model", "embed"), at(0) == "binary"
    rows = lines.filter(~is_blank(F.col("value")) & ~F.col("value").startswith("#"))
    return rows.select(
        at(0).alias("kind"),
        F.when(full, at(1)).when(at(0) == "release", at(2)).alias("repo"),
        F.when(full, at(2)).when(~binary, at(1)).alias("rev"),
        F.when(full, at(3)).when(binary, at(1)).alias("file"),
        F.when(full, at(4)).when(binary, at(2)).try_cast("bigint").alias("bytes"),
        F.when(full, at(5)).when(binary, at(3)).alias("sha256"),
        F.when(full, at(6)).try_cast("int").alias("profile"),
    )


def write_lock(rows: DataFrame, path: str) -> None:
    """Lock rows as text, replacing what is there."""
    line = F.when(F.col("kind").isin("model", "embed"), F.concat_ws(" ", "kind", "repo", "rev", "file", "bytes", "sha256", "profile")).when(F.col("kind") == "binary", F.concat_ws(" ", "kind", "file", "bytes", "sha256")).otherwise(F.concat_ws(" ", "kind", "rev", "repo"))
    rows.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_machine(spark: SparkSession, path: str) -> DataFrame:
    """id, bytes, fits of a machine manifest; empty if it can't be read."""
    schema = "ramBytes bigint, budgetBytes bigint, modelsMax int, models map<string, struct<bytes: bigint, fits: boolean>>"
    try:
        got = spark.read.schema(schema).option("multiLine", "true").json(path)
        got.isEmpty()
    except Exception:  # the manifest is optional: without it every model counts as usable
        got = spark.createDataFrame([], schema)
    return got.select(F.explode("models").alias("id", "m")).select("id", "m.bytes", "m.fits")


def read_stream_tokens(spark: SparkSession, path: str) -> DataFrame:
    """at, content, reasoning of each token in a recorded event stream; lines that aren't JSON are skipped."""
    lines = spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    body = F.try_parse_json(F.expr("substring(line, 7)"))
    data = lines.filter(F.col("line").startswith("data: ") & (F.trim(F.expr("substring(line, 7)")) != "[DONE]")).withColumn("j", body).filter("j IS NOT NULL")
    get = lambda k: F.try_variant_get("j", f"$.choices[0].delta.{k}", "string")
    return data.select("at", get("content").alias("content"), get("reasoning_content").alias("reasoning"))
