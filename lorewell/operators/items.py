"""Item names: context for naming a document, alignment of names in questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.text import strip_image_syntax

# The mark of a slice, and the texts for open and failed alignments.
SLICE_MARK = "【切片】-"
ASK, APOLOGY = "您是想咨询以下哪个产品：", "抱歉，未找到相关产品，请提供更具体的产品名称。"


def item_name_context(chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, context): the first chunks of a document, numbered, without images, up to a budget of code points."""
    k, budget = config.item_name_chunks, config.item_name_chars
    order = Window.partitionBy("doc_id").orderBy("chunk_no")
    rows = chunks.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k)
    rows = rows.withColumn("line", F.concat(F.lit(SLICE_MARK), F.col("i"), F.lit("-"), strip_image_syntax(F.col("content"))))
    rows = rows.withColumn("total", F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.filter(F.col("total") <= budget)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("context"))


def fill_item_name(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Each chunk with its document's item name. The names are hashed, partition by partition; chunks, which hold the texts, only pass by. ``ingest`` has no such join,
    since there the name comes with the document."""
    return chunks.drop("item_name").join(names.select("doc_id", "item_name").hint("shuffle_hash"), "doc_id")


def align_item_names(matches: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(request_id, confirmed, options) from (request_id, name_pos, extracted_name, item_name, score).

    For each extracted name in turn: an item of that very name with a high score, or the only item with one, is confirmed; of several the first three are
    options; without any, the first three of middling score that were not seen yet. The names of a request are folded in order, since what was seen
    before matters; the order within a name is by score, then by arrival (``match_pos`` if there is one).
    """
    arrival = F.col("match_pos") if "match_pos" in matches.columns else F.col("item_name")
    hit = F.struct((-F.col("score")).alias("down"), arrival.alias("arrival"), F.col("item_name"), F.col("score"))
    per_name = matches.groupBy("request_id", "name_pos").agg(F.first("extracted_name").alias("extracted_name"), F.array_sort(F.collect_list(F.when(F.col("item_name").isNotNull(), hit))).alias("hits"))
    names = per_name.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("name_pos", "extracted_name", "hits"))).alias("names"))
    array = "array<string>"
    items = lambda hits: F.transform(hits, lambda h: h["item_name"])
    unseen = lambda xs, acc: F.filter(xs, lambda x: ~F.array_contains(acc["options"], x) & ~F.array_contains(acc["confirmed"], x))

    def step(acc: Column, x: Column) -> Column:
        high = items(F.filter(x["hits"], lambda h: h["score"] >= config.high_score))
        mid = items(F.filter(x["hits"], lambda h: (h["score"] >= config.mid_score) & (h["score"] < config.high_score)))
        exact = F.array_contains(high, x["extracted_name"])
        picked = F.when(exact, F.array(x["extracted_name"])).when(F.size(high) == 1, high).otherwise(F.array().cast(array))
        offered = (
            F.when((F.size(high) > 1) & ~exact, F.array_distinct(unseen(F.slice(high, 1, 3), acc)))
            .when(F.size(high) == 0, F.slice(unseen(mid, acc), 1, 3))
            .otherwise(F.array().cast(array))
        )
        return F.struct(F.array_distinct(F.concat(acc["confirmed"], picked)).alias("confirmed"), F.concat(acc["options"], offered).alias("options"))

    start = F.struct(F.array().cast(array).alias("confirmed"), F.array().cast(array).alias("options"))
    folded = names.select("request_id", F.aggregate("names", start, step).alias("r"))
    return folded.select("request_id", "r.confirmed", F.slice("r.options", 1, config.max_options).alias("options"))


def filter_confirmed(matches: DataFrame, confirmed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(request_id, item_name, best): of several confirmed items those within a gap of the best score; a single one stays whatever its score."""
    wanted = confirmed.select("request_id", F.explode("confirmed").alias("item_name"))
    best = matches.join(wanted, ["request_id", "item_name"]).groupBy("request_id", "item_name").agg(F.max("score").alias("best"))
    top = F.max("best").over(Window.partitionBy("request_id"))
    return best.withColumn("top", top).filter(F.col("top") - F.col("best") <= config.score_gap).select("request_id", "item_name", "best")


def route_requests(aligned: DataFrame) -> DataFrame:
    """``route``: search if an item is confirmed, else clarify if there are options, else apologise; ``answer`` is the text of the latter two."""
    route = F.when(F.size("confirmed") > 0, "search").when(F.size("options") > 0, "clarify").otherwise("apologise")
    answer = F.when(route == "clarify", F.concat(F.lit(ASK), F.array_join("options", ","))).when(route == "apologise", F.lit(APOLOGY))
    return aligned.withColumns({"route": route, "answer": answer})
