"""Questions -> prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config
from ..functions.encoders import HashedTokens
from ..functions.text import parse_extraction
from ..operators.context import build_prompts
from ..operators.fusion import cliff_cutoff, merge_sources, rerank, rrf
from ..operators.items import align_item_names, filter_confirmed, route_requests
from ..operators.vectors import embed, hybrid_search, hyde_queries
from .store import counted, once


def search(requests: DataFrame, chunks: DataFrame, documents: DataFrame, encoder=HashedTokens, config: Config = DEFAULT) -> DataFrame:
    """(request_id, rank, chunk_id, content, title, score): plain and hypothetical-document searches, encoded and searched in one pass over the chunks, fused.

    ``requests``: request_id, query, item_names. ``documents``: request_id, document.
    """
    texts = hyde_queries(requests.select("request_id", "query"), documents)
    keyed = embed(texts, "text", encoder, mode="query").join(requests.select("request_id", "item_names"), "request_id")
    # queries with equal vectors and items are one, under a digest of them; what it finds goes to all that asked it
    parts = F.struct("dense_vector", "sparse_vector", F.array_sort(F.array_distinct("item_names")).alias("items"))
    asked = once(keyed.select("request_id", "path", "item_names", "dense_vector", "sparse_vector", F.sha2(F.to_json(parts), 256).alias("query_id")))
    queries = once(asked.groupBy("query_id").agg(F.first(F.struct(F.col("dense_vector").alias("vector"), F.col("sparse_vector").alias("sparse"), "item_names")).alias("q")).select("query_id", "q.*"))
    corpus = chunks.select("chunk_id", "item_name", F.col("dense_vector").alias("vector"), F.col("sparse_vector").alias("sparse"))
    hits = hybrid_search(queries, corpus, config).join(asked.select("query_id", "request_id", "path"), "query_id")
    rows = with_content(hits.select("request_id", "path", "rank", "chunk_id"), chunks).select("request_id", "path", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "content", "title")
    paths = [(rows.filter(F.col("path") == p).drop("path"), 1.0) for p in ("plain", "hyde")]
    return rrf(paths, config.rrf_k, config.rrf_max)


def with_content(hits: DataFrame, chunks: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``hits`` (chunk_id, ..) with the chunks' content and title. The hits are counted: up to ``most`` bytes of them, at 200 a row, go to the chunks, which are then
    read past them and not moved; of more, both sides are dealt by id, and Spark's filter from the ids of the hits thins out the chunks before that."""
    kept, rows = counted(hits)
    texts = chunks.select("chunk_id", "content", "title")
    return texts.join(F.broadcast(kept), "chunk_id") if rows * 200 <= most else kept.hint("shuffle_hash").join(texts, "chunk_id")


def match_item_names(names: DataFrame, items: DataFrame, encoder=HashedTokens, config: Config = DEFAULT) -> DataFrame:
    """(request_id, name_pos, extracted_name, item_name, score, match_pos): the known items most like each name, best first; a name without any keeps a row.

    ``names``: request_id, name_pos, extracted_name. ``items``: item_name, dense_vector, sparse_vector; of rows with one name any counts. A name is encoded
    and searched once, however many requests have it.
    """
    asked = once(embed(names.select(F.col("extracted_name").alias("query_id")).distinct(), "query_id", encoder, mode="query"))
    queries = asked.select("query_id", F.col("dense_vector").alias("vector"), F.col("sparse_vector").alias("sparse"), F.lit(None).cast("array<string>").alias("item_names"))
    known = items.groupBy("item_name").agg(F.first(F.struct("dense_vector", "sparse_vector")).alias("v"))
    corpus = known.select(F.col("item_name").alias("chunk_id"), "item_name", F.col("v.dense_vector").alias("vector"), F.col("v.sparse_vector").alias("sparse"))
    hits = hybrid_search(queries, corpus, config).select(F.col("query_id").alias("extracted_name"), F.col("chunk_id").alias("item_name"), "score", F.col("rank").alias("match_pos"))
    return names.join(hits, "extracted_name", "left").select("request_id", "name_pos", "extracted_name", "item_name", "score", "match_pos")


def confirm_items(requests: DataFrame, replies: DataFrame, items: DataFrame, encoder=HashedTokens, config: Config = DEFAULT) -> DataFrame:
    """``requests`` (request_id, original_query, ..) with rewritten_query, item_names (the confirmed ones), options, route and answer.

    ``replies``: request_id, raw: what a model extracted from the question. Of several confirmed items those within a gap of the best score stay, best first.
    """
    read = requests.join(replies.select("request_id", "raw"), "request_id", "left").withColumn("reply", parse_extraction(F.col("raw"), F.col("original_query")))
    read = read.select(*[requests[c] for c in requests.columns if c not in ("rewritten_query", "item_names")], F.col("reply.rewritten_query").alias("rewritten_query"), F.col("reply.item_names").alias("_said"))
    names = read.select("request_id", F.posexplode("_said").alias("name_pos", "extracted_name"))
    matches = once(match_item_names(names, items, encoder, config))
    aligned = once(align_item_names(matches, config))
    near = filter_confirmed(matches, aligned.filter(F.size("confirmed") > 1), config)
    kept = near.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("down"), "item_name"))), lambda x: x["item_name"]).alias("_kept"))
    none = F.array().cast("array<string>")
    final = aligned.join(kept, "request_id", "left").select("request_id", F.coalesce("_kept", "confirmed").alias("confirmed"), "options")
    whole = read.drop("_said").join(final, "request_id", "left").withColumns({"confirmed": F.coalesce("confirmed", none), "options": F.coalesce("options", none)})
    return route_requests(whole).withColumnRenamed("confirmed", "item_names")


def answer_requests(requests: DataFrame, replies: DataFrame, items: DataFrame, chunks: DataFrame, documents: DataFrame, web: DataFrame, history: DataFrame, encoder=HashedTokens, scorer=None, config: Config = DEFAULT) -> DataFrame:
    """(request_id, route, item_names, options, answer, prompt): the whole job for a table of questions. Questions with a confirmed item get a prompt, the others
    their answer."""
    asked = once(confirm_items(requests, replies, items, encoder, config))
    found = asked.filter("route = 'search'").select("request_id", "original_query", "rewritten_query", "item_names")
    prompts = retrieve(found, chunks, documents, web.join(found.select("request_id"), "request_id", "left_semi"), history, encoder, scorer, config)
    return asked.select("request_id", "route", "item_names", "options", "answer").join(prompts, "request_id", "left")


def retrieve(requests: DataFrame, chunks: DataFrame, documents: DataFrame, web: DataFrame, history: DataFrame, encoder=HashedTokens, scorer=None, config: Config = DEFAULT) -> DataFrame:
    """(request_id, prompt) for requests whose item names are confirmed.

    ``requests``: request_id, original_query, rewritten_query, item_names. ``web``: request_id, pos, snippet, title, url. ``history``: request_id, pos, role, text.
    """
    asked = requests.withColumn("query", F.coalesce("rewritten_query", "original_query"))
    candidates = merge_sources(search(asked, chunks, documents, encoder, config), web)
    ranked = cliff_cutoff(rerank(candidates.join(asked.select("request_id", "query"), "request_id"), scorer), config)
    return build_prompts(requests, ranked, history, config=config)
