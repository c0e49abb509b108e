"""Task progress and request rates on ``events``: a user is a task, an event type a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.tasklog import request_rate, task_rollup
from ..plans.store import new_folder
from ..streaming.tasks import task_rollup_stream
from .base import table


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup opens and a purchase closes the step entry_node, clicks and views likewise one without a known name; errors end the task."""
    kind = F.col("event_type")
    node = F.when(kind.isin("signup", "purchase"), "entry_node").when(kind.isin("click", "view"), "browse")
    event = F.when(kind.isin("signup", "click"), "start").when(kind.isin("purchase", "view"), "done").when(F.col("value") < 3, "completed").otherwise("failed")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task_id"), node.alias("node"), event.alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.when(kind.isin("purchase", "view"), F.col("value")).alias("duration"))


def shown(tasks: DataFrame) -> DataFrame:
    return tasks.select("task_id", "status", F.array_join("running_list", ",").alias("running"), F.array_join("done_list", ",").alias("done"), F.coalesce(F.try_element_at("durations", F.lit("browse")), F.lit(-1.0)).alias("browse_seconds"), "total_seconds", "progress")


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(task_rollup(task_events(spark, sf_dir)))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, dealt to batches without regard to their order; the last state of each task that the stream gave."""
    source, sink, state = (f"{new_folder(spark)}/rows" for _ in range(3))
    events = task_events(spark, sf_dir)
    # three files, a batch each
    events.repartition(3, F.xxhash64("ts", "task_id")).write.parquet(source)
    stream = task_rollup_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source), late="3650 days")

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(sink)
    return shown(states.groupBy("task_id").agg(F.max_by(F.struct(*[c for c in states.columns if c not in ("task_id", "batch")]), "batch").alias("s")).select("task_id", "s.*"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return request_rate(events, "user_id", 86_400, 3).select("event_id", "recent", "over_limit")


QUERIES = {"task_rollup": rollup, "task_rollup_replayed": replayed, "request_rate": rates}

_ROLLUP = """WITH e AS (SELECT user_id::VARCHAR AS task_id, CASE WHEN event_type IN ('signup', 'purchase') THEN '检查文件' WHEN event_type IN ('click', 'view') THEN 'browse' END AS node,
       CASE WHEN event_type IN ('signup', 'click') THEN 'start' WHEN event_type IN ('purchase', 'view') THEN 'done' WHEN value < 3 THEN 'completed' ELSE 'failed' END AS event, ts, CASE WHEN event_type IN ('purchase', 'view') THEN value END AS duration FROM events),
l AS (SELECT *, max(CASE WHEN event = 'done' THEN ts END) OVER (PARTITION BY task_id, node) AS last_done FROM e),
n AS (SELECT task_id, node, min(ts) FILTER (WHERE event = 'done') AS first_done, min(ts) FILTER (WHERE event = 'start' AND (last_done IS NULL OR ts >= last_done)) AS started, arg_max(event, ts) AS last_event, round(arg_max(duration, ts) FILTER (WHERE event = 'done'), 2) AS seconds FROM l WHERE node IS NOT NULL GROUP BY ALL),
t AS (SELECT task_id, string_agg(node, ',' ORDER BY started, node) FILTER (WHERE last_event = 'start') AS running, string_agg(node, ',' ORDER BY first_done, node) FILTER (WHERE first_done IS NOT NULL) AS done, count(first_done) AS n, max(seconds) FILTER (WHERE node = 'browse') AS browse, round(sum(seconds), 2) AS total FROM n GROUP BY task_id),
s AS (SELECT task_id, arg_max(event, ts) FILTER (WHERE event IN ('completed', 'failed')) AS status FROM e GROUP BY task_id)
SELECT task_id, coalesce(status, 'processing') AS status, coalesce(running, '') AS running, coalesce(done, '') AS done, coalesce(browse, -1.0::DOUBLE) AS browse_seconds, coalesce(total, 0.0::DOUBLE) AS total_seconds, least(100, floor(100 * coalesce(n, 0) / 7.0 + 0.5))::INT AS progress FROM s LEFT JOIN t USING (task_id)"""

SQL = {
    "task_rollup": _ROLLUP,
    "task_rollup_replayed": _ROLLUP,
    "request_rate": """SELECT event_id, count(*) OVER w AS recent, count(*) OVER w > 3 AS over_limit FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""",
}
