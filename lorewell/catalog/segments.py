"""Sections and chunks of ``documents``. The texts have no headings, so every fifth line that isn't blank becomes one, of level 1 to 3 in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import needs_split, resolve_item_name
from ..operators.context import naming_prompts
from ..operators.items import fill_item_name, item_name_context
from ..operators.sections import assemble_chunks, chunk_stats, merge_short_sections, split_by_headings, split_long_sections
from ..plans.ingest import chunk_documents, ingest
from .base import table


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 5 == 0) & x.rlike(r"\S"), F.concat(F.repeat(F.lit("#"), 1 + F.floor(i / 5).cast("int") % 3), F.lit(" "), x)).otherwise(x))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id")).alias("file_title"), F.array_join(lines, "\n").alias("md_content"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_by_headings(marked(spark, sf_dir))


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_chunks(sections(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_stats(sections(spark, sf_dir), plain_chunks(spark, sf_dir))


def long_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("doc_id", "sec_no", F.length("body").alias("body_chars"), needs_split(F.col("title"), F.col("body"), 2000).alias("too_long"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_long_sections(sections(spark, sf_dir)).select("doc_id", "sec_no", "part_no", "title", "body", "parent_title")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_short_sections(sections(spark, sf_dir))


def whole_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = marked(spark, sf_dir)
    return ingest(docs, replies(docs)).select("chunk_id", "doc_id", "chunk_no", "title", "content", "file_title", "parent_title", "item_name", F.size("dense_vector").alias("dim"), F.size("sparse_vector").alias("tokens"))


def replies(docs: DataFrame) -> DataFrame:
    """A reply table: none, UNKNOWN or a name, by document."""
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.lit(" UNKNOWN ")).when(F.col("doc_id") % 3 == 2, F.concat(F.lit(" item "), F.col("doc_id") % 50, F.lit("\n"))).alias("answer"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_name_context(plain_chunks(spark, sf_dir))


def asked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming_prompts(marked(spark, sf_dir), contexts(spark, sf_dir))


def named_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = marked(spark, sf_dir)
    names = docs.join(replies(docs), "doc_id").select("doc_id", resolve_item_name(F.col("answer"), F.col("file_title")).alias("item_name"))
    return fill_item_name(plain_chunks(spark, sf_dir), names).select("doc_id", "chunk_no", "title", "item_name")


def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_documents(marked(spark, sf_dir))
    return chunks.select("doc_id", "chunk_no", "title", "content", "parent_title")


QUERIES = {
    "sections_by_heading": sections,
    "section_chunks": plain_chunks,
    "chunk_stats": stats,
    "section_too_long": long_sections,
    "long_section_pieces": pieces,
    "merged_sections": merged,
    "item_name_context": contexts,
    "naming_prompts": asked_names,
    "chunk_item_names": named_chunks,
    "merged_chunks": merged_chunks,
    "ingest_job": whole_ingest,
}

SECTIONS = r"""
d AS (SELECT doc_id, 'doc ' || doc_id AS file_title, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, file_title, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM d),
v AS (SELECT doc_id, file_title, i, unnest(string_split(replace(replace(CASE WHEN i % 5 = 0 AND regexp_matches(line, '\S') THEN repeat('#', (1 + (i // 5) % 3)::INT) || ' ' || line ELSE line END, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM u),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER w % 2 = 1 AS fenced FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(line, '^\s*#{1,6}\s+.+') THEN length(regexp_extract(line, '^\s*(#{1,6})\s+.+', 1)) END AS level,
             CASE WHEN NOT fenced AND regexp_matches(line, '^\s*#{1,6}\s+.+') THEN regexp_replace(regexp_extract(line, '^\s*#{1,6}\s+(.+)', 1), '^\s+|\s+$', '', 'g') END AS heading FROM f),
n AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec_no,
             [last_value(CASE WHEN level <= 1 THEN nullif(heading, '') END IGNORE NULLS) OVER p, last_value(CASE WHEN level <= 2 THEN nullif(heading, '') END IGNORE NULLS) OVER p,
              last_value(CASE WHEN level <= 3 THEN nullif(heading, '') END IGNORE NULLS) OVER p, last_value(CASE WHEN level <= 4 THEN nullif(heading, '') END IGNORE NULLS) OVER p,
              last_value(CASE WHEN level <= 5 THEN nullif(heading, '') END IGNORE NULLS) OVER p] AS above
      FROM h WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT doc_id, sec_no, min(file_title) AS file_title, coalesce(max(level), 0) AS level, max(heading) AS heading, max(CASE WHEN level > 1 THEN above[level - 1] END) AS parent,
             regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level IS NULL), ''), '^\s+|\s+$', '', 'g') AS body FROM n GROUP BY doc_id, sec_no),
sections AS (SELECT doc_id, sec_no::INT AS sec_no, level::INT AS level, coalesce(nullif(heading, ''), file_title) AS title, body, file_title, coalesce(parent, nullif(heading, ''), file_title) AS parent_title
             FROM g WHERE nullif(heading, '') IS NOT NULL OR body <> ''),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec_no) - 1)::INT AS chunk_no, title, '## ' || title || chr(10) || chr(10) || body AS content, file_title, parent_title FROM sections)"""


def merged_sql(limit: int) -> str:
    """Sections, numbered, and the group that each is merged into."""
    fits = f"r.pending AND r.parent = o.parent_title AND r.held + length(o.body) + 2 <= {limit}"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no) AS k FROM sections),
r AS (SELECT doc_id, k, 0 AS grp, length(body) AS held, length(body) <= 500 AS pending, parent_title AS parent FROM o WHERE k = 1
      UNION ALL
      SELECT o.doc_id, o.k, CASE WHEN {fits} THEN r.grp ELSE r.grp + 1 END, CASE WHEN {fits} THEN r.held + length(o.body) + 2 ELSE length(o.body) END,
             CASE WHEN {fits} THEN true ELSE length(o.body) <= 500 END, o.parent_title
      FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)"""


_CONTEXTS = """c AS (SELECT doc_id, chunk_no + 1 AS i, '【切片】-' || (chunk_no + 1) || '-' || regexp_replace(content, '!\\[[^\\S\\n]*([^\\]\\n]*?)[^\\S\\n]*\\]\\([^()\\n]*(?:\\([^()\\n]*\\)[^()\\n]*)*\\)', '\\1', 'g') AS line FROM chunks WHERE chunk_no < 3),
s AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM c),
x AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS context FROM s WHERE total <= 2500 GROUP BY doc_id)"""

SQL = {
    "sections_by_heading": f"WITH {SECTIONS} SELECT * FROM sections",
    "section_chunks": f"WITH {SECTIONS} SELECT * FROM chunks",
    "chunk_stats": f"""WITH {SECTIONS}
SELECT doc_id, count(*) AS sections, count(*) AS chunks, sum(length(content))::BIGINT AS total_chars, max(length(content))::INT AS max_chars, min(length(content))::INT AS min_chars,
       (sum(length(content)) // count(*))::BIGINT AS mean_chars FROM chunks GROUP BY doc_id""",
    "section_too_long": f"WITH {SECTIONS} SELECT doc_id, sec_no, length(body)::INT AS body_chars, length(title) + 2 + length(body) > 2000 AND length(title) + 2 < 2000 AS too_long FROM sections",
    "merged_sections": f"""WITH RECURSIVE {SECTIONS}, {merged_sql(2000)}
SELECT doc_id, grp::INT AS sec_no, string_agg(title, ' / ' ORDER BY k) AS title, string_agg(body, chr(10) || chr(10) ORDER BY k) AS body, min(file_title) AS file_title, min(parent_title) AS parent_title
FROM r JOIN o USING (doc_id, k) GROUP BY doc_id, grp""",
    "item_name_context": f"WITH {SECTIONS}, {_CONTEXTS} SELECT doc_id, context FROM x",
    "naming_prompts": f"""WITH {SECTIONS}, {_CONTEXTS}
SELECT doc_id, '文件：doc ' || doc_id || chr(10) || chr(10) || coalesce(context, '') || chr(10) || chr(10) || '以上资料介绍的是哪个商品？只写品牌、型号和名称；看不出来就写 UNKNOWN。' AS prompt FROM d LEFT JOIN x USING (doc_id)""",
    "chunk_item_names": f"WITH {SECTIONS} SELECT doc_id, chunk_no, title, CASE WHEN doc_id % 3 = 2 THEN 'item ' || (doc_id % 50) ELSE file_title END AS item_name FROM chunks",
}
