"""Chat history from ``conversations`` (conv_id is the session, turn the time), and prompts from documents, pages and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.context import build_prompts, extraction_prompts, format_documents, format_history, hyde_prompts
from ..operators.history import clear_sessions, history_text, recent_messages, session_history, turns_to_messages, upsert_messages
from ..plans.buckets import append, clear_stored, messages_table, read_buckets, upsert_stored
from ..plans.store import new_folder
from .base import table
from .search import merged_sql, sources, whole_sources


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    key = F.format_string("%d-%03d", "conv_id", "turn")
    return c.select(key.alias("message_id"), F.col("conv_id").cast("string").alias("session_id"), "role", "text", F.lit(None).cast("string").alias("rewritten_query"), F.lit(None).cast("array<string>").alias("item_names"), F.col("turn").cast("double").alias("ts"))


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_messages(messages(spark, sf_dir), 3).select("session_id", "message_id", "role", "text", "ts", "pos")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_text(messages(spark, sf_dir), 4)


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = session_history(messages(spark, sf_dir), 5)
    return out.select("message_id", "session_id", "role", "text", "rewritten_query", F.size("item_names").alias("items"), "ts", "pos")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant's next one, as an answered question; some are unanswered."""
    w = Window.partitionBy("session_id").orderBy("ts")
    rows = messages(spark, sf_dir).withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).filter("role = 'user'")
    return rows.select("session_id", F.col("text").alias("query"), F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise(" \n").alias("answer"), "rewritten_query", "item_names", "ts")


def turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_to_messages(answers(spark, sf_dir)).select("session_id", "role", "text", "ts")


def edits_of(base: DataFrame) -> DataFrame:
    """Every seventh message edited twice, the later edit winning; an edit of a message that isn't there; and one new message a session."""
    seventh = base.filter(F.pmod(F.col("session_id").cast("long") * 8 + F.col("ts").cast("long"), F.lit(7)) == 0)
    edits = [seventh.withColumns({"text": F.concat(F.lit(f"edit {k}: "), F.coalesce("text", F.lit(""))), "ts": F.col("ts") + 100 * k}) for k in (1, 2)]
    lost = seventh.withColumn("message_id", F.concat(F.lit("none-"), "message_id"))
    fresh = base.filter("ts = 0").withColumns({"message_id": F.lit(None).cast("string"), "text": F.lit("hello"), "ts": F.lit(500.0)})
    return edits[0].unionByName(edits[1]).unionByName(lost).unionByName(fresh)


def named(out: DataFrame) -> DataFrame:
    return out.select(F.when(F.col("ts") == 500, F.lit("new")).otherwise(F.col("message_id")).alias("message_id"), "session_id", "role", "text", "ts")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = messages(spark, sf_dir)
    return named(upsert_messages(base, edits_of(base)))


def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edits on a stored table that was written in two parts; then the sessions whose number is a multiple of 3 are cleared."""
    base, kept = messages(spark, sf_dir), messages_table(f"{new_folder(spark)}/messages", 8)
    append(base.filter("ts < 2"), kept)
    append(base.filter("ts >= 2"), kept)
    upsert_stored(edits_of(base), kept)
    clear_stored(base.filter(F.pmod(F.col("session_id").cast("long"), F.lit(3)) == 0).select("session_id"), kept)
    return named(read_buckets(spark, kept))


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = messages(spark, sf_dir)
    gone = base.filter(F.pmod(F.col("session_id").cast("long"), F.lit(3)) == 0).select("session_id")
    kept, deleted = clear_sessions(base, gone)
    left = kept.groupBy("session_id").agg(F.count("*").alias("kept"))
    return left.select("session_id", "kept", F.lit(0).cast("long").alias("deleted")).unionByName(deleted.select("session_id", F.lit(0).cast("long").alias("kept"), "deleted"))


def ranked(found: DataFrame) -> DataFrame:
    return found.select("request_id", F.col("pos").alias("rank"), "content", "title", "chunk_id", "url", "source", F.when(F.col("pos") % 4 != 0, 1 / F.col("pos")).alias("score"))


def ranked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(sources(spark, sf_dir))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_documents(ranked_sources(spark, sf_dir), 2000)


def whole_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents within the default budget, which is the only limit."""
    return format_documents(ranked(whole_sources(spark, sf_dir)))


def asked_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(F.col("session_id").cast("long").alias("request_id"), F.col("ts").cast("int").alias("pos"), "role", "text")


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = asked_history(spark, sf_dir).select("request_id").distinct().withColumn("remaining", 200 + F.col("request_id") % 900)
    return format_history(asked_history(spark, sf_dir), budgets)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("original_query"), F.lit(None).cast("string").alias("rewritten_query"), F.array(F.concat(F.lit("item "), "item_id"), F.lit("x")).alias("item_names"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_prompts(requests(spark, sf_dir), ranked_sources(spark, sf_dir), asked_history(spark, sf_dir))


def whole_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_prompts(requests(spark, sf_dir), ranked(whole_sources(spark, sf_dir)), asked_history(spark, sf_dir))


def asked_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's message as a question about what was said before in its session; in every third session nothing was."""
    said = history_text(messages(spark, sf_dir).filter("cast(session_id as bigint) % 3 <> 0"), 4)
    rows = messages(spark, sf_dir).filter("role = 'user'").select(F.col("message_id").alias("request_id"), "session_id", F.coalesce("text", F.lit("")).alias("original_query"))
    return extraction_prompts(rows, said)


def asked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyde_prompts(requests(spark, sf_dir).withColumn("rewritten_query", F.concat(F.lit("再问："), "original_query")))


QUERIES = {
    "extraction_prompts": asked_extractions,
    "hyde_prompts": asked_documents,
    "recent_messages": recent,
    "history_text": texts,
    "session_view": view,
    "turn_messages": turned,
    "upserted_messages": upserted,
    "cleared_sessions": cleared,
    "stored_changes": stored_changes,
    "document_context": contexts,
    "history_context": histories,
    "prompts": prompts,
    "whole_document_context": whole_contexts,
    "whole_prompts": whole_prompts,
}

_M = "m AS (SELECT conv_id || '-' || printf('%03d', turn) AS message_id, conv_id::VARCHAR AS session_id, role, text, turn::DOUBLE AS ts FROM conversations)"
_ENTRIES = """t AS (SELECT request_id, rank, '[' || rank || '] [source=' || source || ']' || CASE WHEN chunk_id IS NOT NULL THEN ' [chunk_id=' || chunk_id || ']' ELSE '' END || CASE WHEN url <> '' THEN ' [url=' || url || ']' ELSE '' END || ' [title=' || title || ']'
       || CASE WHEN rank % 4 <> 0 THEN printf(' [score=%.4f]', 1.0::DOUBLE / rank) ELSE '' END || chr(10) || content AS entry FROM s),
c AS (SELECT *, sum(length(entry) + 1) OVER (PARTITION BY request_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM t)"""
_SOURCES, _WHOLE_SOURCES = (f"{merged_sql(size)},\n{_ENTRIES}" for size in (20, 50))


def _context(budget: int) -> str:
    return f"""SELECT request_id, coalesce(string_agg(entry, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE spent - 1 <= {budget}), '') AS context,
       ({budget} - coalesce(sum(length(entry) + 1) FILTER (WHERE spent - 1 <= {budget}), 0))::BIGINT AS remaining FROM c GROUP BY request_id"""


_LINES = "l AS (SELECT conv_id AS request_id, turn, CASE role WHEN 'user' THEN '用户' ELSE '助手' END || ': ' || text AS line FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''), k AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY request_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM l)"

_PAST = f"""{_M}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, message_id DESC) AS back FROM m),
h AS (SELECT session_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY back DESC) AS history FROM r WHERE back <= 4 GROUP BY session_id)"""

_UPSERTED = f"""WITH {_M}
SELECT message_id, session_id, role, CASE WHEN (session_id::BIGINT * 8 + ts::BIGINT) % 7 = 0 THEN 'edit 2: ' || coalesce(text, '') ELSE text END AS text, CASE WHEN (session_id::BIGINT * 8 + ts::BIGINT) % 7 = 0 THEN ts + 200 ELSE ts END AS ts FROM m
UNION ALL SELECT 'new', session_id, role, 'hello', 500 FROM m WHERE ts = 0"""

SQL = {
    "extraction_prompts": f"""WITH {_PAST}
SELECT message_id AS request_id, '对话：' || chr(10) || coalesce(CASE WHEN session_id::BIGINT % 3 <> 0 THEN nullif(history, '') END, '暂无上下文') || chr(10) || chr(10) || '问题：' || coalesce(text, '') || chr(10) || chr(10)
       || '找出问题涉及的商品，并把问题改写成不依赖对话也能看懂的一句话。只写 JSON：{{"item_names": [], "rewritten_query": ""}}' AS prompt FROM m LEFT JOIN h USING (session_id) WHERE role = 'user'""",
    "hyde_prompts": """SELECT item_id AS request_id, '商品：item ' || item_id || ', x' || chr(10) || '问题：再问：' || text || chr(10) || chr(10) || '写一段能回答它的产品文档，两三百字。' AS prompt FROM benchmark""",
    "recent_messages": f"""WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, message_id DESC) AS back FROM m)
SELECT session_id, message_id, role, text, ts, row_number() OVER (PARTITION BY session_id ORDER BY back DESC)::INT AS pos FROM r WHERE back <= 3""",
    "history_text": f"""WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, message_id DESC) AS back FROM m)
SELECT session_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY back DESC) AS history FROM r WHERE back <= 4 GROUP BY session_id""",
    "session_view": f"""WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, message_id DESC) AS back FROM m)
SELECT message_id, session_id, role, coalesce(text, '') AS text, '' AS rewritten_query, 0 AS items, ts, row_number() OVER (PARTITION BY session_id ORDER BY back DESC)::INT AS pos FROM r WHERE back <= 5""",
    "turn_messages": f"""WITH {_M}, r AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM m WINDOW w AS (PARTITION BY session_id ORDER BY ts))
SELECT session_id, 'user' AS role, text, ts FROM r WHERE role = 'user' UNION ALL SELECT session_id, 'assistant', next_text, ts FROM r WHERE role = 'user' AND next_role = 'assistant' AND regexp_matches(next_text, '\\S')""",
    "upserted_messages": _UPSERTED,
    "stored_changes": f"SELECT * FROM ({_UPSERTED}) WHERE session_id::BIGINT % 3 <> 0",
    "cleared_sessions": f"""WITH {_M} SELECT session_id, CASE WHEN session_id::BIGINT % 3 <> 0 THEN count(*) ELSE 0 END AS kept, CASE WHEN session_id::BIGINT % 3 = 0 THEN count(*) ELSE 0 END AS deleted FROM m GROUP BY session_id""",
    "document_context": f"WITH {_SOURCES} {_context(2000)}",
    "history_context": f"WITH {_LINES} SELECT request_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM k WHERE used - 1 <= 200 + request_id % 900 GROUP BY request_id",
    "prompts": f"""WITH {_SOURCES}, x AS ({_context(12000)}), {_LINES},
q AS (SELECT item_id AS request_id, text, coalesce(x.context, '') AS context, coalesce(x.remaining, 12000) AS remaining FROM benchmark LEFT JOIN x ON x.request_id = item_id),
h AS (SELECT request_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM k JOIN q USING (request_id) WHERE used - 1 <= remaining GROUP BY request_id)
SELECT request_id, '参考内容：' || chr(10) || coalesce(nullif(context, ''), '无参考内容') || chr(10) || chr(10) || '历史对话：' || chr(10) || coalesce(history, '暂无历史对话') || chr(10) || chr(10)
       || '相关商品：item ' || request_id || ', x' || chr(10) || chr(10) || '问题：' || text AS prompt FROM q LEFT JOIN h USING (request_id)""",
    "whole_document_context": f"WITH {_WHOLE_SOURCES} {_context(12000)}",
    "whole_prompts": f"""WITH {_WHOLE_SOURCES}, x AS ({_context(12000)}), {_LINES},
q AS (SELECT item_id AS request_id, text, coalesce(x.context, '') AS context, coalesce(x.remaining, 12000) AS remaining FROM benchmark LEFT JOIN x ON x.request_id = item_id),
h AS (SELECT request_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM k JOIN q USING (request_id) WHERE used - 1 <= remaining GROUP BY request_id)
SELECT request_id, '参考内容：' || chr(10) || coalesce(nullif(context, ''), '无参考内容') || chr(10) || chr(10) || '历史对话：' || chr(10) || coalesce(history, '暂无历史对话') || chr(10) || chr(10)
       || '相关商品：item ' || request_id || ', x' || chr(10) || chr(10) || '问题：' || text AS prompt FROM q LEFT JOIN h USING (request_id)""",
}
