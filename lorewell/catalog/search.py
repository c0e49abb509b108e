"""Retrieval. Dense search runs on ``embeddings`` (queries: every row whose id is divisible by 20, filtered by label); sparse search on the words of ``documents``
(queries likewise, filtered by source); fused lists, reranking and cutoffs on their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Config
from ..functions.text import is_blank
from ..operators.fusion import cliff_cutoff, hit_stats, merge_sources, normalize_hits, rerank, rrf
from ..operators.vectors import dense_topk, embed, hybrid, hyde_queries, sparse_topk, to_sparse_map, validate_vectors
from ..plans.store import once
from .base import spread, table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("item_name"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector", F.array("item_name").alias("item_names"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_topk(vector_queries(spark, sf_dir), corpus(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words with their counts, in the row that holds its text: the words are sorted, so a count is the distance of two ends of runs."""
    words = F.sort_array(F.array_remove(F.split(F.lower("text"), r"[^a-z0-9]+"), ""))
    docs = spread(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", "text")).select("doc_id", "source", words.alias("w"))
    last = lambda i: (i > 0) & ((i == F.size("w")) | (F.get("w", i - 1) != F.get("w", i)))
    ends = docs.withColumn("ends", F.filter(F.sequence(F.lit(0), F.size("w")), last))
    counts = F.transform("ends", lambda end, i: (end - F.coalesce(F.get("ends", i - 1), F.lit(0))).cast("float"))
    return ends.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("item_name"), to_sparse_map(F.transform("ends", lambda end: F.get("w", end - 1)), counts).alias("sparse"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = once(word_vectors(spark, sf_dir)).filter(F.size("sparse") > 0)
    queries = chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.array("item_name").alias("item_names"), "sparse")
    return sparse_topk(queries, chunks, 5)


def with_sparse(df: DataFrame) -> DataFrame:
    """The positive components of the vector as a sparse one."""
    entries = F.filter(F.transform("vector", lambda x, i: F.struct(i.cast("long").alias("token"), x.alias("weight"))), lambda e: e["weight"] > 0)
    return df.withColumn("sparse", F.map_from_entries(entries))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, queries = with_sparse(corpus(spark, sf_dir)), with_sparse(vector_queries(spark, sf_dir))
    return hybrid(dense_topk(queries, chunks, 5), sparse_topk(queries, chunks, 5), 5).withColumn("score", F.round("score", 6))


def two_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The five nearest by cosine and the five largest by inner product, as ranked hits."""
    chunks, queries = corpus(spark, sf_dir), vector_queries(spark, sf_dir)
    near, large = dense_topk(queries, chunks, 5), dense_topk(queries, chunks, 5, metric="ip")
    hit = lambda df: df.select(F.col("query_id").alias("request_id"), F.col("rank").alias("pos"), F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), F.concat(F.lit("chunk "), F.col("chunk_id")).alias("content")).alias("entity"))
    return normalize_hits(hit(near)), normalize_hits(hit(large))


def ranks_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_paths(spark, sf_dir)
    return rrf([(a, 1.0), (b, 1.0)]).withColumn("score", F.round("score", 12))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_stats(ranks_fused(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors -> two ranked paths -> fusion -> cutoff at the largest drop."""
    return cliff_cutoff(ranks_fused(spark, sf_dir).select("request_id", "rank", "chunk_id", "score"), Config(rerank_gap=0.001))


def nearest_ten_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = dense_topk(vector_queries(spark, sf_dir), corpus(spark, sf_dir), 10)
    ranked = ranked.select(F.col("query_id").alias("request_id"), "chunk_id", F.round("score", 6).alias("score"), "rank")
    return cliff_cutoff(ranked, Config(rerank_gap=0.02))


def hyde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's own title as the question, and its whole text as the hypothetical document; a missing text gives none."""
    docs = table(spark, sf_dir, "documents")
    requests = docs.select(F.col("doc_id").alias("request_id"), F.concat(F.lit("doc "), F.col("doc_id")).alias("query"))
    return hyde_queries(requests, docs.filter("text is not null").select(F.col("doc_id").alias("request_id"), F.col("text").alias("document")))


def whole_hyde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the benchmark's questions for each document, with the whole document as the hypothetical one; a blank text gives none."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.pmod("doc_id", F.lit(asked.count())).alias("item"), F.col("text").alias("document"))
    return hyde_queries(docs.join(asked, "item").select("request_id", "query"), docs.filter(~is_blank(F.col("document"))))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a candidate for one of the benchmark's questions."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.pmod("doc_id", F.lit(asked.count())).alias("request_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"))
    return docs.join(asked, "request_id")


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank(candidates(spark, sf_dir)).select("request_id", "pos", F.round("score", 9).alias("score"), "rank")


def paragraphs(html: Column) -> Column:
    """All paragraphs of a page, without tags."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.array_join(F.transform(found, lambda x: F.regexp_replace(x, "<[^>]*>", "")), "\n")


def asker(id_col: str, size: int) -> Column:
    """The request that a row is dealt to: ``size`` rows in the order of their ids have one, so there are more requests the more rows there are."""
    return F.floor(F.col(id_col) / size).cast("long").alias("request_id")


def web_pages(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(asker("page_id", size), F.col("page_id").alias("pos"), paragraphs(F.col("html")).alias("snippet"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), "url")


def local_hits(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(asker("doc_id", size), F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.concat(F.lit("doc "), F.col("doc_id")).alias("title"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_sources(local_hits(spark, sf_dir), web_pages(spark, sf_dir))


def whole_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, more rows to a request."""
    return merge_sources(local_hits(spark, sf_dir, 50), web_pages(spark, sf_dir, 50))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = embed(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text"), "text")
    ok, _ = validate_vectors(docs)
    return ok.select("doc_id", F.size("dense_vector").alias("dim"), F.size("sparse_vector").alias("tokens"), F.aggregate(F.map_values("sparse_vector"), F.lit(0.0), lambda s, v: s + v.cast("double")).alias("weight"))


QUERIES = {
    "dense_topk": dense,
    "sparse_topk": sparse,
    "hybrid_topk": fused,
    "rank_fusion": ranks_fused,
    "hit_stats": stats,
    "fused_cliff": flagship,
    "nearest_cliff": nearest_ten_cut,
    "hyde_queries": hyde,
    "whole_hyde_queries": whole_hyde,
    "reranked": reranked,
    "merged_sources": sources,
    "merged_whole_sources": whole_sources,
    "embedded_documents": embedded,
}

_PAIRS = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS q, c.vec_id AS c, list_cosine_similarity(q.v, c.v) AS cosine, list_inner_product(q.v, c.v) AS product FROM e q JOIN e c USING (label) WHERE q.vec_id % 20 = 0)"""
_FUSED = f"""{_PAIRS},
a AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 12) DESC, c) AS r FROM p),
b AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY round(product, 9) DESC, c) AS r FROM p),
u AS (SELECT q, c, 0 AS path, r FROM a WHERE r <= 5 UNION ALL SELECT q, c, 1, r FROM b WHERE r <= 5),
s AS (SELECT q, c, sum(1.0::DOUBLE / (60 + r)) AS score, min(path * 1000 + r) AS first FROM u GROUP BY q, c),
f AS (SELECT q AS request_id, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, first)::INT AS rank, c::VARCHAR AS chunk_id, round(score, 12) AS score, 'chunk ' || c AS content FROM s),
fused AS (SELECT * FROM f WHERE rank <= 10)"""


def _cliff(rows: str, gap: float) -> str:
    return f"""d AS (SELECT *, round(score - lead(score) OVER (PARTITION BY request_id ORDER BY rank), 12) AS fall, count(*) OVER (PARTITION BY request_id) AS n FROM {rows} WHERE rank <= 10),
k AS (SELECT request_id, any_value(n) AS n, arg_max(rank, fall * 1e6 - rank * 1e-9) FILTER (WHERE fall >= {gap}) AS spot FROM d GROUP BY request_id)"""


def merged_sql(size: int) -> str:
    """The whole texts of documents and pages, dealt to requests."""
    blanks = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return rf"""a AS (SELECT doc_id // {size} AS request_id, 0 AS side, doc_id AS spot, trim(text, {blanks}) AS content, 'doc ' || doc_id AS title, doc_id::VARCHAR AS chunk_id, '' AS url, 'local' AS source FROM documents),
b AS (SELECT page_id // {size} AS request_id, 1 AS side, page_id AS spot, trim(regexp_replace(array_to_string(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), chr(10)), '<[^>]*>', '', 'g'), {blanks}) AS content,
      trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, NULL AS chunk_id, trim(url) AS url, 'web' AS source FROM pages),
u AS (SELECT * FROM a WHERE content <> '' UNION ALL SELECT * FROM b WHERE content <> '' AND title <> '' AND url <> ''),
s AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY side, spot) AS rank, content, title, chunk_id, url, source FROM u)"""


SQL = {
    "dense_topk": f"""WITH {_PAIRS}, r AS (SELECT q AS query_id, c AS chunk_id, cosine, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 12) DESC, c)::INT AS rank FROM p)
SELECT query_id, chunk_id, round(cosine, 6) AS score, rank FROM r WHERE rank <= 5""",
    "sparse_topk": r"""WITH w AS (SELECT doc_id, source, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM documents),
n AS (SELECT doc_id, source, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
s AS (SELECT q.doc_id AS query_id, c.doc_id AS chunk_id, sum(q.n * c.n)::DOUBLE AS score FROM n q JOIN n c USING (source, word) WHERE q.doc_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "hybrid_topk": f"""WITH {_PAIRS},
z AS (SELECT q.vec_id AS q, c.vec_id AS c, list_sum(list_transform(range(1, 1 + len(q.v)), lambda i: CASE WHEN q.v[i] > 0 AND c.v[i] > 0 THEN q.v[i] * c.v[i] ELSE 0 END)) AS product,
      list_sum(list_transform(range(1, 1 + len(q.v)), lambda i: CASE WHEN q.v[i] > 0 AND c.v[i] > 0 THEN 1 ELSE 0 END)) AS shared FROM e q JOIN e c USING (label) WHERE q.vec_id % 20 = 0),
a AS (SELECT q, c, 0.5 * (1 + cosine) / 2 AS part, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 12) DESC, c) AS r FROM p),
b AS (SELECT q, c, 0.5 * (0.5 + atan(product) / pi()) AS part, row_number() OVER (PARTITION BY q ORDER BY product DESC, c) AS r FROM z WHERE shared > 0),
s AS (SELECT q AS query_id, c AS chunk_id, sum(part) AS score FROM (SELECT * FROM a WHERE r <= 5 UNION ALL SELECT * FROM b WHERE r <= 5) GROUP BY q, c),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id)::INT AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM f WHERE rank <= 5""",
    "rank_fusion": f"WITH {_FUSED} SELECT * FROM fused",
    "hit_stats": f"WITH {_FUSED} SELECT count(DISTINCT request_id) AS queries, count(*) AS hits, min(score) AS min_score, max(score) AS max_score FROM fused",
    "fused_cliff": f"WITH {_FUSED}, {_cliff('fused', 0.001)} SELECT request_id, rank, chunk_id, score FROM fused JOIN k USING (request_id) WHERE rank <= greatest(least(3, n), coalesce(spot, n))",
    "nearest_cliff": f"""WITH {_PAIRS}, t AS (SELECT q AS request_id, c AS chunk_id, round(cosine, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 12) DESC, c)::INT AS rank FROM p), {_cliff('t', 0.02)}
SELECT request_id, chunk_id, score, rank FROM t JOIN k USING (request_id) WHERE rank <= 10 AND rank <= greatest(least(3, n), coalesce(spot, n))""",
    "hyde_queries": """SELECT doc_id AS request_id, 'plain' AS path, 'doc ' || doc_id AS text FROM documents UNION ALL SELECT doc_id, 'hyde', 'doc ' || doc_id || chr(10) || coalesce(text, '') FROM documents""",
    "reranked": r"""WITH n AS (SELECT count(*) AS n FROM benchmark),
c AS (SELECT doc_id % n AS request_id, doc_id AS pos, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS words FROM documents, n WHERE text IS NOT NULL),
q AS (SELECT item_id AS request_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS asked FROM benchmark),
s AS (SELECT request_id, pos, coalesce(len(list_intersect(asked, words))::DOUBLE / nullif(len(asked), 0), 0) AS score FROM c JOIN q USING (request_id))
SELECT request_id, pos, round(score, 9) AS score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos)::INT AS rank FROM s""",
    "merged_sources": f"WITH {merged_sql(20)} SELECT request_id, rank::INT AS pos, content, title, chunk_id, url, source FROM s",
    "merged_whole_sources": f"WITH {merged_sql(50)} SELECT request_id, rank::INT AS pos, content, title, chunk_id, url, source FROM s",
    "whole_hyde_queries": r"""WITH n AS (SELECT count(*) AS n FROM benchmark),
r AS (SELECT doc_id, b.text AS query, CASE WHEN regexp_matches(d.text, '\S') THEN d.text END AS document FROM documents d, n JOIN benchmark b ON b.item_id = d.doc_id % n)
SELECT doc_id AS request_id, 'plain' AS path, query AS text FROM r UNION ALL SELECT doc_id, 'hyde', query || chr(10) || coalesce(document, '') FROM r""",
}
