"""Chat formatting: fold an event log into final messages, then render them with a loss mask.

Events: (conv_id, seq, event, turn, role, text). In the order of ``seq``, ``message`` starts the message at ``turn`` anew, ``delta`` appends to
it, ``edit`` replaces its text, and ``regenerate`` drops it and all later turns. The fold is declarative: a window finds the last
regeneration at or before each turn, another the last event that set the text anew, and the rest is concatenated in order, one group per
message. Only the finished messages of a conversation meet in one row.

Template. ``<s>`` opens a conversation; a system text stands between ``<<SYS>>`` and ``<</SYS>>``, a user text between ``[INST] `` and
`` [/INST]``, an assistant text is closed by ``</s>``, and any other role is written ``[ROLE]role[TEXT]text[/ROLE]``. Inside texts and roles
a backslash is doubled and each control string gets one after its first character, so none of them can be mistaken for a mark and
``unescape`` restores the text.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .work import read_table

CONTROL = r"(<)(/?s>|</?SYS>>)|(\[)(/?INST\]|/?ROLE\]|TEXT\])"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1$3\\\\$2$4")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), one row per final message.

    A null text counts as empty, a null role as ''; of several roles the last one set holds. Null ids form a conversation, a null turn or seq sorts
    first. Equal ``seq`` values in one message are taken in the order of their texts. Rows that repeat an event are applied as often as they
    stand there. Further columns are ignored, whatever their names; an empty log gives no message. A text may be of any length, in any number of deltas.
    """
    # within a conversation, ordered by turn: the latest regeneration of this turn or an earlier one
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    message = Window.partitionBy("conv_id", "turn")
    live = (
        events.select("conv_id", "seq", "event", "turn", F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("_regen", F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).over(by_turn))
        .filter("event <> 'regenerate' and (_regen is null or seq > _regen)")
        .withColumn("_reset", F.max(F.when(F.col("event").isin("message", "edit"), F.col("seq"))).over(message))
    )
    counted = F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset"))
    parts = F.array_sort(F.collect_list(F.when(counted, F.struct("seq", "text"))))
    roles = F.max_by("role", F.when(F.col("role").isNotNull(), F.coalesce("seq", F.lit(-1))))
    return live.groupBy("conv_id", "turn").agg(F.coalesce(roles, F.lit("")).alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the whole conversation and the code-point spans [start, end) under the loss mask, one per assistant text, from one row per
    (conv_id, turn). Other columns are ignored; the time is linear in the turns and in their texts."""
    role, text = F.col("role"), escape(F.col("text"))
    opened = F.when(role == "system", MARKS["system"][0]).when(role == "user", MARKS["user"][0]).when(role == "assistant", MARKS["assistant"][0]).otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[TEXT]")))
    closed = F.when(role == "system", MARKS["system"][1]).when(role == "user", MARKS["user"][1]).when(role == "assistant", MARKS["assistant"][1]).otherwise("[/ROLE]")
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    turns = messages.select("conv_id", "turn", (role == "assistant").alias("loss"), opened.alias("opened"), text.alias("text"), closed.alias("closed"))
    length = F.length("opened") + F.length("text") + F.length("closed")
    start = F.lit(len("<s>")) + F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("opened")
    placed = turns.select("conv_id", F.struct(start.alias("start"), "loss", "opened", "text", "closed").alias("m"))
    # the order of turns is that of their places
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    spans = F.transform(F.filter("ms", lambda m: m["loss"]), lambda m: F.struct(m["start"].cast("int").alias("start"), (m["start"] + F.length(m["text"])).cast("int").alias("end")))
    return whole.select("conv_id", F.concat(F.lit("<s>"), F.array_join(F.transform("ms", lambda m: F.concat(m["opened"], m["text"], m["closed"])), "")).alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs back from the rendered conversation."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        for role in ("system", "user", "other", "assistant"):
            opened, closed = MARKS.get(role, ("[ROLE]", "[/ROLE]"))
            if formatted.startswith(opened, at):
                end = formatted.index(closed, at + len(opened))
                body = formatted[at + len(opened) : end]
                at = end + len(closed)
                if role == "other":
                    name, _, body = body.partition("[TEXT]")
                    role = unescape(name)
                turns.append((role, unescape(body)))
                break
    return turns


def chat_format(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def conversation_events(rows: DataFrame, chunk: int = 256) -> DataFrame:
    """The log that would have streamed these finished rows: an opening event per row, then its text in deltas of ``chunk`` code points. Rows are taken
    in the order of turn, role and text; a null text is an opening event alone. A text is cut by one pass over it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    text = F.coalesce("text", F.lit(""))
    numbered = rows.select("conv_id", "role", text.alias("text"), F.row_number().over(order).cast("long").alias("turn"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{chunk}}})"), F.lit(1))
    deltas = F.concat(F.array(F.struct(F.lit("message").alias("event"), F.lit("").alias("text"))), F.transform(pieces, lambda p: F.struct(F.lit("delta").alias("event"), p.alias("text"))))
    return numbered.select("conv_id", "turn", "role", F.posexplode(deltas).alias("n", "e")).select("conv_id", (F.col("turn") * F.lit(1 << 32) + F.col("n")).alias("seq"), "e.event", "turn", "role", "e.text")


def _read_back(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for f, own in zip(formatted, spans):
        turns = parse(f)
        loss = "".join(unescape(f[s["start"] : s["end"]]) for s in own)
        rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(f)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: Column, spans: Column) -> Column:
    """Digests of what the rendered text and its loss mask say."""
    as_udf = F.pandas_udf(_read_back, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return as_udf(formatted, spans)


#: The conversation -1 that the query's contract adds: its texts are made of control strings.
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{EXTRA_TEXT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    out = chat_format(conversation_events(rows.unionByName(extra)))
    return out.withColumn("r", read_back(F.col("formatted"), F.col("loss_spans"))).select("conv_id", "r.*")


SQL = {
    "op6_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>|</?SYS>>)|(\[)(/?INST\]|/?ROLE\]|TEXT\])', '\1\3#\2\4', 'g')) AS n,
             length(regexp_replace(replace(role, '\', '\\'), '(<)(/?s>|</?SYS>>)|(\[)(/?INST\]|/?ROLE\]|TEXT\])', '\1\3#\2\4', 'g')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 19 + r END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
}
