"""Rank fusion, merging of sources, reranking, cutoff."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.text import is_blank, strip, strip_image_syntax


def normalize_hits(hits: DataFrame) -> DataFrame:
    """Hits without an entity dropped, the others unwrapped and ranked from 1 in arrival order (``pos``)."""
    w = Window.partitionBy("request_id").orderBy("pos")
    return hits.filter("entity is not null").withColumn("rank", F.row_number().over(w)).select("request_id", "rank", "entity.*")


def rrf(paths: list[tuple[DataFrame, float]], k: int = DEFAULT.rrf_k, limit: int = DEFAULT.rrf_max) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (request_id, rank, chunk_id, payload columns).

    A row with a blank chunk id counts in the ranks but isn't fused. Ties keep the order of arrival: first path first, then rank. The payload is that of
    the first arrival.
    """
    parts = [df.withColumns({"path_no": F.lit(i), "gain": F.lit(float(w)) / (k + F.col("rank"))}) for i, (df, w) in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    payload = [c for c in rows.columns if c not in ("request_id", "rank", "chunk_id", "path_no", "gain")]
    arrival = F.struct("path_no", "rank")
    kept = rows.filter(~is_blank(F.col("chunk_id").cast("string")))
    fused = kept.groupBy("request_id", "chunk_id").agg(F.sum("gain").alias("score"), F.min(arrival).alias("first"), F.min_by(F.struct(F.lit(0).alias("_"), *payload), arrival).alias("payload"))
    w = Window.partitionBy("request_id").orderBy(F.round("score", 12).desc(), "first")
    ranked = fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.select("request_id", "rank", "chunk_id", "score", *[F.col("payload")[c].alias(c) for c in payload])


def hit_stats(hits: DataFrame) -> DataFrame:
    """Queries and hits of a run, with the range of scores."""
    return hits.agg(F.count_distinct("request_id").alias("queries"), F.count("*").alias("hits"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def merge_sources(local: DataFrame, web: DataFrame) -> DataFrame:
    """(request_id, pos, content, title, chunk_id, url, source): local documents with content, then web pages with snippet, title and address."""
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    a = local.select("request_id", F.lit(0).alias("side"), F.col("rank").alias("at"), text("content").alias("content"), text("title").alias("title"), F.col("chunk_id").cast("string").alias("chunk_id"), F.lit("").alias("url"), F.lit("local").alias("source")).filter("content <> ''")
    b = web.select("request_id", F.lit(1).alias("side"), F.col("pos").alias("at"), text("snippet").alias("content"), text("title").alias("title"), F.lit(None).cast("string").alias("chunk_id"), text("url").alias("url"), F.lit("web").alias("source")).filter("content <> '' and title <> '' and url <> ''")
    w = Window.partitionBy("request_id").orderBy("side", "at")
    return a.unionByName(b).withColumn("pos", F.row_number().over(w)).select("request_id", "pos", "content", "title", "chunk_id", "url", "source")


def token_overlap(query: Column, content: Column) -> Column:
    """The share of the query's distinct words that stand in the content: the default pair score."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(query), words(content))).cast("double"), F.size(words(query))), F.lit(0.0))


def rerank(candidates: DataFrame, scorer: Callable[[], Callable] | None = None) -> DataFrame:
    """Candidates with (request_id, query, pos, content) scored from 0 to 1 and ranked, best first, unscored last in their old order.

    ``scorer`` makes a model, once per task: lists of queries and contents to raw scores, or None where it fails; they pass through a sigmoid. If it raises,
    the requests of that batch are scored one at a time, and those it still fails on have null scores. Without one the score is the overlap of words.
    """
    if scorer is None:
        scored = candidates.withColumn("score", token_overlap(F.col("query"), strip_image_syntax(F.col("content"))))
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", _bare string, score double"

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            try:
                model = scorer()
            except Exception:  # no model: nothing is scored
                model = None

            def scores(pdf: pd.DataFrame) -> pd.Series | None:
                try:
                    raw = model(pdf["query"].tolist(), pdf["_bare"].tolist())
                except Exception:  # whatever the model raises, its rows stay without scores
                    return None
                return pd.Series([None] * len(pdf) if raw is None else raw, index=pdf.index, dtype="float64")

            for pdf in parts:
                found = scores(pdf)
                if found is None:
                    each = [scores(own) for _, own in pdf.groupby("request_id", dropna=False)]
                    found = pd.concat([pd.Series(dtype="float64"), *[x for x in each if x is not None]]).reindex(pdf.index)
                yield pdf.assign(score=found)

        scored = candidates.withColumn("_bare", strip_image_syntax(F.col("content"))).mapInPandas(run, schema).drop("_bare")
        scored = scored.withColumn("score", F.when(F.isnan("score"), None).otherwise(1 / (1 + F.exp(-F.col("score")))))
    w = Window.partitionBy("request_id").orderBy(F.col("score").desc_nulls_last(), "pos")
    return scored.withColumn("rank", F.row_number().over(w))


def cliff_cutoff(ranked: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The head of each request's ranking: of the first ``rerank_max`` rows, up to the largest drop in score if that is ``rerank_gap`` or more (the first of
    equal ones), but ``rerank_min`` rows at least."""
    order = Window.partitionBy("request_id").orderBy("rank")
    whole = Window.partitionBy("request_id")
    head = ranked.filter(F.col("rank") <= config.rerank_max)
    drop = F.round(F.col("score") - F.lead("score").over(order), 12)
    head = head.withColumn("drop", drop).withColumn("n", F.count("*").over(whole))
    cut = F.max(F.when(F.col("drop") >= config.rerank_gap, F.struct("drop", (-F.col("rank")).alias("at")))).over(whole)
    keep = F.greatest(F.least(F.lit(config.rerank_min), F.col("n")), F.coalesce(-F.col("cut.at"), F.col("n")))
    return head.withColumn("cut", cut).filter(F.col("rank") <= keep).drop("drop", "n", "cut")
