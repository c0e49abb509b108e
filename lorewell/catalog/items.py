"""Alignment of item names. The dictionary is the distinct ``part.p_name``; a question names a part by its name or only half of it, and the score of a match is the
share of common words."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.items import align_item_names, filter_confirmed, route_requests
from ..operators.vectors import embed
from ..plans.retrieve import answer_requests, confirm_items
from ..plans.store import once
from .base import spread, table


def matches(spark: SparkSession, sf_dir: str, names_per_request: int = 1) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    said = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.element_at(F.split("p_name", " "), -1)).otherwise(F.concat("p_name", F.lit(" kit")))
    asked = part.select((F.floor(F.col("p_partkey") / names_per_request)).alias("request_id"), F.col("p_partkey").alias("name_pos"), said.alias("extracted_name"))
    names = part.select(F.col("p_name").alias("item_name")).distinct()
    word = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("word")
    shared = asked.select("*", word("extracted_name")).join(names.select("item_name", word("item_name")), "word").groupBy("request_id", "name_pos", "extracted_name", "item_name").agg(F.count("*").alias("n"))
    words = lambda c: F.size(F.array_distinct(F.split(c, " ")))
    score = F.round(F.col("n") / (words("extracted_name") + words("item_name") - F.col("n")), 6) + F.lit(0.1)
    scored = shared.select("request_id", "name_pos", "extracted_name", "item_name", F.round(F.least(score, F.lit(1.0)), 6).alias("score"))
    return asked.join(scored, ["request_id", "name_pos", "extracted_name"], "left")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = route_requests(align_item_names(matches(spark, sf_dir)))
    return out.select("request_id", F.array_join("confirmed", "|").alias("confirmed"), F.array_join("options", "|").alias("options"), "route", "answer")


def aligned_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_item_names(matches(spark, sf_dir, 4))
    return out.select("request_id", F.array_join("confirmed", "|").alias("confirmed"), F.array_join("options", "|").alias("options"))


def best_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of four parts a request, all taken as confirmed: those near the best score stay."""
    m = matches(spark, sf_dir, 4)
    confirmed = m.filter("score >= 0.5").groupBy("request_id").agg(F.collect_set("item_name").alias("confirmed"))
    return filter_confirmed(m, confirmed)


class LetterCounts:
    """An encoder that SQL can restate: how often each of a to z stands in a text, less a half in the dense vector, and by eighths in the sparse one."""

    def __call__(self, texts: list[str], mode: str = "document") -> tuple[np.ndarray, list[dict[int, float]]]:
        counts = [[t.count(c) for c in string.ascii_lowercase] for t in texts]
        return np.array(counts, np.float32).reshape(len(texts), 26) - np.float32(0.5), [{i: n / 8 for i, n in enumerate(row) if n} for row in counts]


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(requests, replies): four parts a request, named as in ``matches``; every fifth reply is in a code fence, and every fifth broken."""
    part = matches(spark, sf_dir, 4).select("request_id", "name_pos", "extracted_name").distinct()
    names = part.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("name_pos", "extracted_name"))), lambda x: x["extracted_name"]).alias("item_names"))
    requests = names.select("request_id", F.concat(F.lit("question "), "request_id").alias("original_query"))
    body = F.to_json(F.struct("item_names", F.concat(F.lit("asks "), "request_id").alias("rewritten_query")))
    k = F.pmod("request_id", F.lit(5))
    return requests, names.select("request_id", F.when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 3, F.concat(F.lit("{"), body)).otherwise(body).alias("raw"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies read, names matched by hybrid search with the distinct part names, aligned, filtered and routed."""
    items = embed(table(spark, sf_dir, "part").select(F.col("p_name").alias("item_name")).distinct(), "item_name", LetterCounts)
    out = confirm_items(*asked(spark, sf_dir), items, LetterCounts)
    return out.select("request_id", "rewritten_query", F.array_join("item_names", "|").alias("item_names"), F.array_join("options", "|").alias("options"), "route", "answer")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: the questions above, their names confirmed; parts as chunks, searched with the question and with a hypothetical document (of two in three);
    pages as what a web search found, conversations as history; fused, reranked, cut off, and put into prompts."""
    part = table(spark, sf_dir, "part")
    items = embed(part.select(F.col("p_name").alias("item_name")).distinct(), "item_name", LetterCounts)
    content = F.concat("p_name", F.lit(" is a "), F.lower("p_type"), F.lit(" by "), "p_brand", F.lit(", size "), "p_size")
    # kept, as both legs read the vectors
    chunks = once(embed(spread(part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("item_name"), F.concat(F.lit("part "), "p_partkey").alias("title"), content.alias("content"))), "content", LetterCounts))
    request = F.floor(F.col("p_partkey") / 4)
    documents = part.groupBy(request.alias("request_id")).agg(F.min(F.lower("p_type")).alias("document")).filter("request_id % 3 <> 0")
    said = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    web = table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), F.lit(0).alias("pos"), F.concat(said, F.lit(" online")).alias("snippet"), said.alias("title"), "url")
    history = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("pos"), "role", "text")
    out = answer_requests(*asked(spark, sf_dir), items, chunks, documents, web, history, LetterCounts)
    return out.select("request_id", "route", F.array_join("item_names", "|").alias("item_names"), "answer", "prompt")


QUERIES = {"answers": answers, "aligned_names": aligned, "aligned_names_together": aligned_together, "best_confirmed": best_confirmed, "answered_requests": answered}


def _matches(per: int) -> str:
    return f"""
a AS (SELECT p_partkey // {per} AS request_id, p_partkey AS name_pos, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[-1] ELSE p_name || ' kit' END AS extracted_name FROM part),
i AS (SELECT DISTINCT p_name AS item_name FROM part),
x AS (SELECT DISTINCT *, unnest(string_split(extracted_name, ' ')) AS word FROM a),
y AS (SELECT DISTINCT item_name, unnest(string_split(item_name, ' ')) AS word FROM i),
g AS (SELECT request_id, name_pos, extracted_name, item_name, count(*) AS n FROM x JOIN y USING (word) GROUP BY ALL),
m AS (SELECT request_id, name_pos, extracted_name, item_name, round(least(round(n / (len(list_distinct(string_split(extracted_name, ' '))) + len(list_distinct(string_split(item_name, ' '))) - n), 6) + 0.1, 1.0::DOUBLE), 6) AS score FROM g)"""


def _aligned(hits: str) -> str:
    """From ``hits`` (request_id, pos, name, high, mid): what is confirmed and offered after each name of a request, and after the last."""
    new = lambda xs: f"list_filter({xs}, lambda x: NOT list_contains(r.options, x) AND NOT list_contains(r.confirmed, x))"
    return f"""r AS (SELECT DISTINCT request_id, 0::BIGINT AS pos, []::VARCHAR[] AS confirmed, []::VARCHAR[] AS options FROM {hits}
      UNION ALL
      SELECT r.request_id, r.pos + 1, CASE WHEN list_contains(n.high, n.name) AND NOT list_contains(r.confirmed, n.name) THEN list_append(r.confirmed, n.name)
                                           WHEN len(n.high) = 1 AND NOT list_contains(n.high, n.name) AND NOT list_contains(r.confirmed, n.high[1]) THEN list_append(r.confirmed, n.high[1]) ELSE r.confirmed END,
             list_concat(r.options, CASE WHEN len(n.high) > 1 AND NOT list_contains(n.high, n.name) THEN {new("n.high[1:3]")} WHEN len(n.high) = 0 THEN {new("n.mid")}[1:3] ELSE []::VARCHAR[] END)
      FROM r JOIN {hits} n ON n.request_id = r.request_id AND n.pos = r.pos),
z AS (SELECT request_id, arg_max(confirmed, pos) AS confirmed, arg_max(options, pos)[1:3] AS options FROM r GROUP BY request_id)"""


_CONFIRMED = f"""x AS (SELECT p_partkey // 4 AS request_id, row_number() OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) - 1 AS pos,
             CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[-1] ELSE p_name || ' kit' END AS name FROM part),
v AS (SELECT name, list_transform(range(97, 123), lambda c: (len(name) - len(replace(name, chr(c::INT), '')))::DOUBLE) AS n FROM (SELECT name FROM x UNION SELECT p_name FROM part)),
p AS (SELECT a.name, b.name AS item, list_cosine_similarity(list_transform(a.n, lambda y: y - 0.5), list_transform(b.n, lambda y: y - 0.5)) AS cosine, list_inner_product(a.n, b.n) / 64 AS product
      FROM (SELECT * FROM v WHERE name IN (SELECT name FROM x)) a, (SELECT * FROM v WHERE name IN (SELECT p_name FROM part)) b),
d AS (SELECT name, item, 0.5 * (1 + cosine) / 2 AS part, row_number() OVER (PARTITION BY name ORDER BY round(cosine, 12) DESC, item) AS k FROM p),
s AS (SELECT name, item, 0.5 * (0.5 + atan(product) / pi()) AS part, row_number() OVER (PARTITION BY name ORDER BY round(product, 9) DESC, item) AS k FROM p WHERE product > 0),
f AS (SELECT name, item, sum(part) AS score FROM (SELECT * FROM d WHERE k <= 5 UNION ALL SELECT * FROM s WHERE k <= 5) GROUP BY name, item),
m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(score, 12) DESC, item) <= 5),
h AS (SELECT name, coalesce(list(item ORDER BY round(score, 12) DESC, item) FILTER (WHERE score >= 0.7), []) AS high, coalesce(list(item ORDER BY round(score, 12) DESC, item) FILTER (WHERE score >= 0.6 AND score < 0.7), []) AS mid FROM m GROUP BY name),
n AS (SELECT request_id, pos, name, high, mid FROM x JOIN h USING (name) WHERE request_id % 5 <> 3),
{_aligned("n")},
b AS (SELECT request_id, item, max(score) AS best FROM x JOIN m USING (name) JOIN z USING (request_id) WHERE list_contains(confirmed, item) AND len(confirmed) > 1 GROUP BY request_id, item),
k AS (SELECT request_id, list(item ORDER BY best DESC, item) AS kept FROM (SELECT * FROM b QUALIFY max(best) OVER (PARTITION BY request_id) - best <= 0.15) GROUP BY request_id),
t AS (SELECT q.request_id, q.request_id % 5 = 3 AS broken, coalesce(kept, confirmed, []) AS names, coalesce(options, []) AS options FROM (SELECT DISTINCT request_id FROM x) q LEFT JOIN z USING (request_id) LEFT JOIN k USING (request_id)),
w AS (SELECT *, CASE WHEN len(names) > 0 THEN 'search' WHEN len(options) > 0 THEN 'clarify' ELSE 'apologise' END AS route FROM t)"""

_ROUTED = "CASE route WHEN 'clarify' THEN '您是想咨询以下哪个产品：' || array_to_string(options, ',') WHEN 'apologise' THEN '抱歉，未找到相关产品，请提供更具体的产品名称。' END"

SQL = {
    "answers": f"""WITH RECURSIVE {_CONFIRMED},
ch AS (SELECT p_partkey AS c, p_name AS item, 'part ' || p_partkey AS title, p_name || ' is a ' || lower(p_type) || ' by ' || p_brand || ', size ' || p_size AS content FROM part),
hy AS (SELECT request_id, min(kind) AS document FROM (SELECT p_partkey // 4 AS request_id, lower(p_type) AS kind FROM part) WHERE request_id % 3 <> 0 GROUP BY request_id),
qs AS (SELECT request_id, 'asks ' || request_id AS query, names FROM w WHERE route = 'search'),
qt AS (SELECT request_id, names, 0 AS path, query AS txt FROM qs UNION ALL SELECT request_id, names, 1, query || chr(10) || coalesce(document, '') FROM qs LEFT JOIN hy USING (request_id)),
l1 AS (SELECT *, list_transform(range(97, 123), lambda z: (len(txt) - len(replace(txt, chr(z::INT), '')))::DOUBLE) AS n FROM qt),
l2 AS (SELECT *, list_transform(range(97, 123), lambda z: (len(content) - len(replace(content, chr(z::INT), '')))::DOUBLE) AS n FROM ch),
pp AS (SELECT request_id, path, c, list_cosine_similarity(list_transform(l1.n, lambda y: y - 0.5), list_transform(l2.n, lambda y: y - 0.5)) AS cosine, list_inner_product(l1.n, l2.n) / 64 AS product
       FROM (SELECT *, unnest(names) AS item FROM l1) l1 JOIN l2 USING (item)),
dd AS (SELECT request_id, path, c, 0.5 * (1 + cosine) / 2 AS part, row_number() OVER (PARTITION BY request_id, path ORDER BY round(cosine, 12) DESC, c) AS k FROM pp),
ss AS (SELECT request_id, path, c, 0.5 * (0.5 + atan(product) / pi()) AS part, row_number() OVER (PARTITION BY request_id, path ORDER BY round(product, 9) DESC, c) AS k FROM pp WHERE product > 0),
ff AS (SELECT request_id, path, c, sum(part) AS score FROM (SELECT * FROM dd WHERE k <= 5 UNION ALL SELECT * FROM ss WHERE k <= 5) GROUP BY ALL),
hh AS (SELECT *, row_number() OVER (PARTITION BY request_id, path ORDER BY round(score, 12) DESC, c) AS rank FROM ff),
rr AS (SELECT request_id, c, sum(1.0::DOUBLE / (60 + rank)) AS gain, min(path * 1000 + rank) AS first FROM hh WHERE rank <= 5 GROUP BY ALL),
lo AS (SELECT request_id, c, row_number() OVER (PARTITION BY request_id ORDER BY round(gain, 12) DESC, first) AS rank FROM rr),
src AS (SELECT request_id, 0 AS side, rank AS spot, content, title, c::VARCHAR AS chunk_id, '' AS url, 'local' AS source FROM lo JOIN ch USING (c) WHERE rank <= 10
        UNION ALL SELECT page_id, 1, 0, trim(name || ' online'), trim(name), NULL, trim(url), 'web' FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name FROM pages) JOIN qs ON request_id = page_id WHERE trim(name) <> '' AND trim(url) <> ''),
mg AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY side, spot) AS pos FROM src),
wo AS (SELECT mg.*, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')) AS wanted, list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')) AS said FROM mg JOIN qs USING (request_id)),
sc AS (SELECT *, coalesce(len(list_intersect(wanted, said))::DOUBLE / nullif(len(wanted), 0), 0) AS score FROM wo),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) AS rank FROM sc),
dr AS (SELECT *, round(score - lead(score) OVER (PARTITION BY request_id ORDER BY rank), 12) AS fall, count(*) OVER (PARTITION BY request_id) AS many FROM rk WHERE rank <= 10),
ct AS (SELECT request_id, any_value(many) AS many, arg_max(rank, fall * 1e6 - rank * 1e-9) FILTER (WHERE fall >= 0.5) AS spot FROM dr GROUP BY request_id),
en AS (SELECT request_id, rank, '[' || rank || '] [source=' || source || ']' || coalesce(' [chunk_id=' || chunk_id || ']', '') || CASE WHEN url <> '' THEN ' [url=' || url || ']' ELSE '' END || ' [title=' || title || ']' || printf(' [score=%.4f]', score) || chr(10) || content AS entry
       FROM dr JOIN ct USING (request_id) WHERE rank <= greatest(least(3, ct.many), coalesce(ct.spot, ct.many))),
ec AS (SELECT *, sum(length(entry) + 1) OVER (PARTITION BY request_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM en),
cx AS (SELECT request_id, string_agg(entry, chr(10) || chr(10) ORDER BY rank) AS context, (12000 - sum(length(entry) + 1))::BIGINT AS remaining FROM ec WHERE spent - 1 <= 12000 GROUP BY request_id),
ln AS (SELECT conv_id AS request_id, turn, CASE role WHEN 'user' THEN '用户' ELSE '助手' END || ': ' || text AS line FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''),
us AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY request_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM ln),
hs AS (SELECT qs.request_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM us JOIN qs ON qs.request_id = us.request_id LEFT JOIN cx ON cx.request_id = qs.request_id WHERE used - 1 <= coalesce(remaining, 12000) GROUP BY qs.request_id),
pm AS (SELECT request_id, '参考内容：' || chr(10) || coalesce(context, '无参考内容') || chr(10) || chr(10) || '历史对话：' || chr(10) || coalesce(history, '暂无历史对话') || chr(10) || chr(10)
       || '相关商品：' || array_to_string(names, ', ') || chr(10) || chr(10) || '问题：' || query AS prompt FROM qs LEFT JOIN cx USING (request_id) LEFT JOIN hs USING (request_id))
SELECT request_id, route, array_to_string(names, '|') AS item_names, {_ROUTED} AS answer, prompt FROM w LEFT JOIN pm USING (request_id)""",
    "answered_requests": f"""WITH RECURSIVE {_CONFIRMED}
SELECT request_id, CASE WHEN broken THEN 'question ' ELSE 'asks ' END || request_id AS rewritten_query, array_to_string(names, '|') AS item_names, array_to_string(options, '|') AS options, route, {_ROUTED} AS answer FROM w""",
    "aligned_names_together": f"""WITH RECURSIVE {_matches(4)},
o AS (SELECT a.request_id, row_number() OVER (PARTITION BY a.request_id ORDER BY a.name_pos) - 1 AS pos, a.extracted_name AS name, coalesce(high, []) AS high, coalesce(mid, []) AS mid
      FROM a LEFT JOIN (SELECT name_pos, list(item_name ORDER BY score DESC, item_name) FILTER (WHERE score >= 0.7) AS high, list(item_name ORDER BY score DESC, item_name) FILTER (WHERE score >= 0.6 AND score < 0.7) AS mid FROM m GROUP BY name_pos) USING (name_pos)),
{_aligned("o")}
SELECT request_id, array_to_string(confirmed, '|') AS confirmed, array_to_string(options, '|') AS options FROM z""",
    "aligned_names": f"""WITH {_matches(1)},
h AS (SELECT request_id, list(item_name ORDER BY score DESC, item_name) FILTER (WHERE score >= 0.7) AS high, list(item_name ORDER BY score DESC, item_name) FILTER (WHERE score >= 0.6 AND score < 0.7) AS mid FROM m GROUP BY request_id),
r AS (SELECT request_id, CASE WHEN list_contains(high, extracted_name) THEN [extracted_name] WHEN len(high) = 1 THEN high ELSE [] END AS confirmed,
             CASE WHEN high IS NULL THEN coalesce(mid, [])[1:3] WHEN len(high) > 1 AND NOT list_contains(high, extracted_name) THEN high[1:3] ELSE [] END AS options FROM a LEFT JOIN h USING (request_id)),
t AS (SELECT request_id, coalesce(array_to_string(confirmed, '|'), '') AS confirmed, coalesce(array_to_string(options, '|'), '') AS options, CASE WHEN len(confirmed) > 0 THEN 'search' WHEN len(options) > 0 THEN 'clarify' ELSE 'apologise' END AS route, array_to_string(options, ',') AS offered FROM r)
SELECT request_id, confirmed, options, route, CASE route WHEN 'clarify' THEN '您是想咨询以下哪个产品：' || offered WHEN 'apologise' THEN '抱歉，未找到相关产品，请提供更具体的产品名称。' END AS answer FROM t""",
    "best_confirmed": f"""WITH {_matches(4)}, b AS (SELECT request_id, item_name, max(score) AS best FROM m GROUP BY ALL HAVING max(score) >= 0.5)
SELECT * FROM b QUALIFY max(best) OVER (PARTITION BY request_id) - best <= 0.15""",
}
