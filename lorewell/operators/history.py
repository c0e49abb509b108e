"""The chat history table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT
from ..functions.text import is_blank


def recent_messages(messages: DataFrame, n: int = DEFAULT.history_for_model) -> DataFrame:
    """The last n messages of each session with ``pos`` from 1, oldest first; of equal times the larger id is later."""
    late = Window.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("message_id").desc())
    rows = messages.withColumn("back", F.row_number().over(late)).filter(F.col("back") <= n)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("back").desc()))).drop("back")


def history_text(messages: DataFrame, n: int = DEFAULT.history_for_model) -> DataFrame:
    """(session_id, history): the last n messages as ``role: text`` lines."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return recent_messages(messages, n).withColumn("line", line).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("history"))


def history_view(messages: DataFrame, *also: str) -> DataFrame:
    """What the interface shows of a message, with defaults for what is missing, and further columns as they are."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return messages.select(text("message_id"), text("session_id"), text("role"), text("text"), text("rewritten_query"), F.coalesce("item_names", F.array().cast("array<string>")).alias("item_names"), "ts", *also)


def session_history(messages: DataFrame, n: int = DEFAULT.history_for_view) -> DataFrame:
    """The last n messages of each session as the interface shows them, with ``pos``."""
    return history_view(recent_messages(messages, n), "pos")


def turns_to_messages(answers: DataFrame) -> DataFrame:
    """(session_id, query, answer, rewritten_query, item_names, ts) -> a user message, and an assistant's unless the answer is blank."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("text"), F.lit(role == "assistant").alias("reply"))
    both = F.array(message("user", "query"), message("assistant", "answer"))
    rows = answers.withColumn("m", F.explode(both)).filter(~F.col("m.reply") | ~is_blank(F.col("m.text")))
    return rows.select("session_id", F.col("m.role").alias("role"), F.col("m.text").alias("text"), "rewritten_query", "item_names", "ts")


def upsert_messages(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes without an id are new rows, with an id derived from their content; the others replace the row of that id (the latest of several), and change
    nothing where there is none. A change without a time is older than those with one."""
    cols = base.columns
    blank = is_blank(F.col("message_id"))
    fresh = changes.filter(blank).withColumn("message_id", F.sha2(F.to_json(F.struct(*[c for c in cols if c != "message_id"])), 256)).select(cols)
    last = changes.filter(~blank).groupBy("message_id").agg(F.max_by(F.struct(*[c for c in cols if c != "message_id"]), F.struct(F.col("ts").isNotNull(), "ts")).alias("new"))
    replaced = base.join(last, "message_id", "left").select(*[F.col(c) if c == "message_id" else F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in cols])
    return replaced.unionByName(fresh)


def clear_sessions(base: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, the number of messages deleted per session)."""
    gone = sessions.select("session_id").distinct()
    return base.join(gone, "session_id", "left_anti"), base.join(gone, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("deleted"))
