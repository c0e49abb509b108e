"""Progress of tasks from their event log, and request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT

# The names shown for the steps of both flows.
STEP_NAMES = {
    "upload_file": "上传文件",
    "entry_node": "检查文件",
    "pdf_to_md_node": "PDF转Markdown",
    "md_img_node": "Markdown图片处理",
    "document_split_node": "文档切分",
    "item_name_recognition_node": "主体名称识别",
    "bge_embedding_node": "向量生成",
    "import_milvus_node": "导入向量数据库",
    "__end__": "处理完成",
    "item_name_confirm": "确认问题产品",
    "answer_output": "生成答案",
    "rerank": "重排序",
    "rrf": "倒排融合",
    "web_search_mcp": "网络搜索",
    "search_embedding": "切片搜索",
    "search_embedding_hyde": "切片搜索(假设性文档)",
}


def step_name(node: Column, names: dict[str, str] | None = None) -> Column:
    """The name shown for a step; one that isn't known is shown as it is."""
    known = STEP_NAMES if names is None else names
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), node), node)


def task_rollup(events: DataFrame, total_steps: int = DEFAULT.total_steps["md"], names: dict[str, str] | None = None) -> DataFrame:
    """(task_id, status, running_list, done_list, durations, total_seconds, progress) from (task_id, node, event, ts, duration).

    Events are start, done, fail (of a step) and completed, failed (of the task, without a step). Done are the steps that ever finished, in that order;
    running those whose latest event is a start, in the order they started since they last finished; a step's duration is its latest. The window and the
    first aggregation share one exchange.
    """
    nodes = events.filter("node is not null").withColumn("shown", step_name(F.col("node"), names))
    at = F.struct("ts", "event")
    done = F.col("event") == "done"
    nodes = nodes.withColumn("last_done", F.max(F.when(done, F.col("ts"))).over(Window.partitionBy("task_id", "shown")))
    since = (F.col("event") == "start") & (F.col("last_done").isNull() | (F.col("ts") >= F.col("last_done")))
    per_node = nodes.groupBy("task_id", "shown").agg(
        F.min(F.when(done, F.col("ts"))).alias("first_done"),
        F.min(F.when(since, F.col("ts"))).alias("started"),
        F.max_by("event", at).alias("last_event"),
        F.round(F.max_by("duration", F.when(done & F.col("duration").isNotNull(), at)), 2).alias("seconds"),
    )
    in_order = lambda cond, by: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(by).alias("at"), F.col("shown"))))), lambda x: x["shown"])
    per_task = per_node.groupBy("task_id").agg(
        in_order(F.col("last_event") == "start", "started").alias("running_list"),
        in_order(F.col("first_done").isNotNull(), "first_done").alias("done_list"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("seconds").isNotNull(), F.struct("shown", "seconds"))))).alias("durations"),
        F.coalesce(F.round(F.sum("seconds"), 2), F.lit(0.0)).alias("total_seconds"),
    )
    status = events.filter(F.col("event").isin("completed", "failed")).groupBy("task_id").agg(F.max_by("event", at).alias("status"))
    progress = F.least(F.lit(100), F.floor(100 * F.size("done_list") / F.lit(total_steps) + 0.5)).cast("int")
    tasks = events.select("task_id").distinct().join(per_task, "task_id", "left").join(status, "task_id", "left")
    none = F.array().cast("array<string>")
    tasks = tasks.withColumns({"status": F.coalesce("status", F.lit("processing")), "running_list": F.coalesce("running_list", none), "done_list": F.coalesce("done_list", none), "total_seconds": F.coalesce("total_seconds", F.lit(0.0))})
    return tasks.withColumn("progress", progress).select("task_id", "status", "running_list", "done_list", "durations", "total_seconds", "progress")


def request_rate(events: DataFrame, key: str, seconds: int = 60, limit: int = DEFAULT.requests_per_minute, slice_seconds: int | None = None) -> DataFrame:
    """``events`` with the number of their key's events in the trailing window (now - seconds, now], and whether it exceeds the limit.

    The windows go over slices of time, by default ten times as long as the trailing window, and not over a key's whole history: each slice also has the key's
    events of the ``seconds`` before it, which are counted and then left out. An event is in at most as many slices as a trailing window touches, and a key
    with all events is as many groups as it has slices. An event without a time counts those of its key that have none either.
    """
    width = (slice_seconds or 10 * seconds) * 1_000_000
    reach = seconds * 1_000_000 - 1
    at, own, last = "_at", "_own_slice", "_slice"
    timed = events.withColumn(at, F.unix_micros("ts")).withColumn(own, F.floor(F.col(at) / width))
    # the slices whose events can see this one
    seen = F.when(F.col(at).isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.col(own), F.floor((F.col(at) + reach) / width)))
    rows = timed.withColumn(last, F.explode(seen))
    w = Window.partitionBy(key, last).orderBy(at).rangeBetween(-reach, 0)
    counted = rows.withColumn("recent", F.count("*").over(w)).filter(F.col(last).eqNullSafe(F.col(own)))
    return counted.drop(at, own, last).withColumn("over_limit", F.col("recent") > limit)
