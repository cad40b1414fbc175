"""Conversation history: recent messages, summaries, inheritance, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT, RETAINED, TITLE = 16, 100, 34
#: Words that refer to what was said before.
FOLLOWUP = "刚才|上面|上一|前面|这道|这个|继续|再|换一|为什么|that|this|above|previous|again|continue"


def messages(requests: DataFrame) -> DataFrame:
    """(session_id, seq, role, content, created_at): all messages of every session in order of request and place."""
    rows = requests.select("session_id", "request_id", "created_at", F.posexplode("messages").alias("at", "m")).where("session_id IS NOT NULL")
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "request_id", "at"))
    return rows.select("session_id", order.cast("bigint").alias("seq"), F.col("m.role").alias("role"), F.col("m.content").alias("content"), "created_at")


def recent(log: DataFrame, most: int = RECENT) -> DataFrame:
    """The last messages of every session."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    return log.withColumn("_b", back).where(F.col("_b") <= most).drop("_b")


def summaries(log: DataFrame) -> DataFrame:
    """(session_id, title, started, updated, n): the first words of the user as title."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("seq")))
    out = log.groupBy("session_id").agg(first.alias("first"), F.min("created_at").alias("started"), F.max("created_at").alias("updated"), F.count("*").alias("n"))
    text = F.trim(F.regexp_replace(F.coalesce("first", F.lit("")), r"\n\[附件：(?s).*", ""))
    return out.withColumn("title", F.when(F.length(text) > TITLE, F.concat(F.substring(text, 1, TITLE), F.lit("…"))).otherwise(text)).select("session_id", "title", "started", "updated", "n")


def previous_user(log: DataFrame) -> DataFrame:
    """log with asked: what the user last said before each message."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w))


def inherit(log: DataFrame, value: Column, name: str) -> DataFrame:
    """log with name: the value of the message, else the last one before it in its session."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn(name, F.last(value, ignorenulls=True).over(w))


def is_followup(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(FOLLOWUP), F.lit(False))


def history_text(log: DataFrame, most: int = 6, length: int = 900) -> DataFrame:
    """(session_id, history): the last messages as lines of role and content."""
    rows = recent(log, most).withColumn("line", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, length)))
    listed = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return listed.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("history"))
