"""Conversation views over messages (chat_id, pos, role, content, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.text import age_bucket, title_from, unicode_trim


def first_user(messages: DataFrame) -> DataFrame:
    """chat_id, content of the first message of a user that isn't blank."""
    mine = messages.filter((F.col("role") == "user") & (unicode_trim(F.col("content")) != ""))
    return mine.groupBy("chat_id").agg(F.min_by("content", "pos").alias("content"))


def titles(messages: DataFrame) -> DataFrame:
    """chat_id, title for every conversation with a message."""
    user = F.when((F.col("role") == "user") & (unicode_trim(F.col("content")) != ""), F.struct("pos", "content"))
    got = messages.groupBy("chat_id").agg(F.min(user).alias("f"))
    return got.select("chat_id", title_from(F.col("f.content")).alias("title"))


def metas(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """id, title, model, created, updated, count; the latest first (to the second), then by id descending."""
    user = F.when((F.col("role") == "user") & (unicode_trim(F.col("content")) != ""), F.struct("pos", "content"))
    got = messages.groupBy(F.col("chat_id").alias("id")).agg(F.count("*").alias("count"), F.min(user).alias("f"))
    out = chats.join(got, "id", "left").select("id", title_from(F.col("f.content")).alias("title"), "model", "created", "updated", F.coalesce("count", F.lit(0)).alias("count"))
    return out.orderBy(F.date_trunc("second", "updated").desc(), F.desc("id"))


def with_messages(chats: DataFrame, messages: DataFrame, chat_id: str) -> DataFrame:
    """One conversation with its messages in order."""
    mine = messages.filter(F.col("chat_id") == chat_id)
    got = mine.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("pos", "role", "content", "ts", "sources") if c in messages.columns]))).alias("messages"))
    return chats.filter(F.col("id") == chat_id).join(got, F.col("id") == F.col("chat_id"), "left").drop("chat_id")


def drop_last(messages: DataFrame) -> DataFrame:
    """Messages without the last intact one of each conversation."""
    return messages.withColumn("last_", F.max("pos").over(Window.partitionBy("chat_id"))).filter(F.col("pos") < F.col("last_")).drop("last_")


def replay(messages: DataFrame) -> DataFrame:
    """What is sent back to a model: role and content, in order."""
    return messages.select("chat_id", "pos", "role", "content")


def search_titles(metas_: DataFrame, text: str) -> DataFrame:
    """Conversations whose title holds a text, whatever its case; all for a blank one."""
    text = text.strip().lower()
    return metas_.filter(F.lower("title").contains(text)) if text else metas_


def buckets(metas_: DataFrame, today: Column) -> DataFrame:
    """metas with bucket, and header: whether a list of all conversations shows the bucket's name before the row.

    Buckets follow the order of the list, so a header stands before the first row of each bucket."""
    out = metas_.withColumn("bucket", age_bucket(F.to_date("updated"), today))
    first = Window.partitionBy("bucket").orderBy(F.date_trunc("second", "updated").desc(), F.desc("id"))
    return out.withColumn("header", F.row_number().over(first) == 1)
