"""Prompt assembly within a budget of code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.text import is_blank, none_if_blank, render_prompt, strip

# The labels of roles, and the texts for what is missing.
ROLES = {"user": "用户", "assistant": "助手"}
NO_CONTEXT, NO_HISTORY, NO_TALK = "无参考内容", "暂无历史对话", "暂无上下文"

#: The default prompts; their names are those that the functions below fill in.
ANSWER_TEMPLATE = "参考内容：\n{context}\n\n历史对话：\n{history}\n\n相关商品：{item_names}\n\n问题：{question}"
NAMING_TEMPLATE = "文件：{file_title}\n\n{context}\n\n以上资料介绍的是哪个商品？只写品牌、型号和名称；看不出来就写 UNKNOWN。"
EXTRACTION_TEMPLATE = "对话：\n{history_text}\n\n问题：{query}\n\n找出问题涉及的商品，并把问题改写成不依赖对话也能看懂的一句话。只写 JSON：{{\"item_names\": [], \"rewritten_query\": \"\"}}"
HYDE_TEMPLATE = "商品：{item_hint}\n问题：{rewritten_query}\n\n写一段能回答它的产品文档，两三百字。"


def _ordered(c: str, *by: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, c))), lambda x: x[c])


def format_documents(ranked: DataFrame, budget: int = DEFAULT.prompt_chars) -> DataFrame:
    """(request_id, context, remaining): documents in order of ``rank`` as ``[n] [source=..] ..`` and content, until one exceeds the budget.

    A blank document takes a number but no room. Scores are written with four digits. Each document costs its length and one; the row stands for a
    request even if nothing fits.
    """
    order = Window.partitionBy("request_id").orderBy("rank")
    tag = lambda k, c: F.when(~is_blank(c), F.concat(F.lit(f"[{k}="), strip(c), F.lit("]")))
    tags = F.concat_ws(" ", F.concat(F.lit("["), F.row_number().over(order), F.lit("]")), *[tag(k, F.col(k).cast("string")) for k in ("source", "chunk_id", "url", "title")], F.when(F.col("score").isNotNull(), F.format_string("[score=%.4f]", F.col("score").cast("double"))))
    rows = ranked.withColumn("entry", F.when(~is_blank(F.col("content")), F.concat(tags, F.lit("\n"), strip(F.col("content")))))
    cost = F.coalesce(F.length("entry") + 1, F.lit(0))
    rows = rows.withColumns({"cost": cost, "spent": F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    fits = F.col("spent") - 1 <= budget
    # once a document exceeds the budget all later ones do, since the running sum grows
    return rows.groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits & F.col("entry").isNotNull(), F.struct("rank", "entry")))), lambda x: x["entry"]), "\n\n").alias("context"),
        (F.lit(budget) - F.coalesce(F.sum(F.when(fits, F.col("cost"))), F.lit(0))).cast("long").alias("remaining"),
    )


def format_history(messages: DataFrame, budgets: DataFrame) -> DataFrame:
    """(request_id, history): a request's messages (request_id, pos, role, text), oldest first, within what the documents left of the budget."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("role"))
    rows = messages.filter(F.col("role").isin(*ROLES) & F.col("text").isNotNull() & (F.col("text") != "")).withColumn("line", F.concat(label, F.lit(": "), F.col("text")))
    order = Window.partitionBy("request_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("spent", F.sum(F.length("line") + 1).over(order)).join(budgets.select("request_id", "remaining"), "request_id")
    return rows.filter(F.col("spent") - 1 <= F.col("remaining")).groupBy("request_id").agg(F.array_join(_ordered("line", "pos"), "\n").alias("history"))


def naming_prompts(docs: DataFrame, contexts: DataFrame, template: str = NAMING_TEMPLATE) -> DataFrame:
    """(doc_id, prompt) from documents (doc_id, file_title) and their first chunks (doc_id, context): what a model is asked to name a document."""
    rows = docs.select("doc_id", "file_title").join(contexts.select("doc_id", "context"), "doc_id", "left")
    return rows.select("doc_id", render_prompt(template, file_title=F.col("file_title"), context=F.col("context")).alias("prompt"))


def extraction_prompts(requests: DataFrame, histories: DataFrame, template: str = EXTRACTION_TEMPLATE) -> DataFrame:
    """(request_id, prompt) from requests (request_id, session_id, original_query) and histories (session_id, history): what a model is asked to find the items
    of a question."""
    rows = requests.join(histories.select("session_id", "history"), "session_id", "left")
    talk = F.when(F.length("history") > 0, F.col("history")).otherwise(NO_TALK)
    return rows.select("request_id", render_prompt(template, history_text=talk, query=F.col("original_query")).alias("prompt"))


def hyde_prompts(requests: DataFrame, template: str = HYDE_TEMPLATE) -> DataFrame:
    """(request_id, prompt) from requests (request_id, item_names, rewritten_query): what a model is asked to write a hypothetical document."""
    return requests.select("request_id", render_prompt(template, item_hint=F.array_join("item_names", ", "), rewritten_query=F.col("rewritten_query")).alias("prompt"))


def build_prompts(requests: DataFrame, ranked: DataFrame, history: DataFrame, template: str = ANSWER_TEMPLATE, config: Config = DEFAULT) -> DataFrame:
    """(request_id, prompt): one per request, also where nothing was found."""
    found = format_documents(ranked, config.prompt_chars)
    budgets = requests.select("request_id").join(found, "request_id", "left").select("request_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("remaining", F.lit(config.prompt_chars)).alias("remaining"))
    said = format_history(history, budgets)
    rows = requests.join(budgets, "request_id").join(said, "request_id", "left")
    prompt = render_prompt(
        template,
        context=F.coalesce(none_if_blank(F.col("context")), F.lit(NO_CONTEXT)),
        history=F.coalesce(none_if_blank(F.col("history")), F.lit(NO_HISTORY)),
        item_names=F.array_join("item_names", ", "),
        question=F.coalesce(none_if_blank(F.col("rewritten_query")), F.col("original_query")),
    )
    return rows.select("request_id", prompt.alias("prompt"))
