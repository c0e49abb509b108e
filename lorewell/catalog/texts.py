"""Scalar text functions, tables, images and links on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.links import normalize_link_urls
from ..functions.tables import complex_table, linearize_tables
from ..functions.text import embedding_input, format_duration, normalize_newlines, object_url, parse_extraction, parse_web_results, prepare_requests, resolve_item_name, strip_image_syntax, valid_inputs
from ..operators.images import image_context, match_images, replace_image_links
from ..sources.files import referenced_images
from .base import table


def illustrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a heading before and an image behind every third line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## part "), i, F.lit("\n"), x, F.lit("\n![ alt "), i, F.lit(" ](images/pic"), i, F.lit("_(1).png)"))).otherwise(x))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", F.array_join(lines, "\n").alias("md_content"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files of each document: one more than it refers to, and every fifth left out."""
    n = F.explode(F.sequence(F.lit(0), F.floor((F.size(F.split("text", "\n")) - 1) / 3).cast("int") + 1)).alias("n")
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", n).filter("n % 5 <> 4").select("doc_id", F.concat(F.lit("pic"), F.col("n") * 3, F.lit("_(1).png")).alias("name"))


def alt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = illustrated(spark, sf_dir)
    return docs.select("doc_id", strip_image_syntax(F.col("md_content")).alias("bare"), embedding_input(F.col("source"), F.col("md_content")).alias("embedded"))


def lines_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.replace(F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit(",\r"))
    return table(spark, sf_dir, "documents").select("doc_id", normalize_newlines(mixed).alias("text"))


def used_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, unused = match_images(illustrated(spark, sf_dir), pictures(spark, sf_dir))
    return used.select("doc_id", "name", F.lit(True).alias("used")).unionByName(unused.select("doc_id", "name", F.lit(False).alias("used")))


def by_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images named by the ends of what the documents refer to, as 3_(1).png for pic3_(1).png, pic33_(1).png and others."""
    short = pictures(spark, sf_dir).withColumn("name", F.substring("name", 4, 100))
    used, unused = match_images(illustrated(spark, sf_dir), short, by_suffix=True)
    return used.select("doc_id", "name", F.lit(True).alias("used")).unionByName(unused.select("doc_id", "name", F.lit(False).alias("used")))


def beside_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in fifty folders, and in each folder the images that some of the numbers of its documents give; those that each document refers to."""
    place = lambda name: F.concat(F.lit("file:/kb/f"), F.col("doc_id") % 50, F.lit(name))
    docs = illustrated(spark, sf_dir).withColumn("path", F.concat(place("/d"), "doc_id", F.lit(".md")))
    own = F.concat(F.lit("pic"), F.floor(F.col("doc_id") / 50) % 40 * 3, F.lit("_(1).png"))
    images = table(spark, sf_dir, "documents").select(own.alias("name"), F.concat(place("/images/"), own).alias("path")).distinct()
    return referenced_images(images, docs)


def image_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_context(illustrated(spark, sf_dir), pictures(spark, sf_dir))


def linked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = pictures(spark, sf_dir).filter("name <> 'pic3_(1).png'")
    summaries = known.select("doc_id", "name", F.concat(F.lit("about "), "name").alias("summary"), object_url(F.lit("http://store"), F.lit("kb"), F.col("doc_id").cast("string"), F.col("name")).alias("url"))
    return replace_image_links(illustrated(spark, sf_dir), summaries).select("doc_id", "md_content")


def object_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", object_url(F.lit("http://store"), F.lit("kb"), F.concat("p_brand", F.lit(" (A)")), F.concat(F.lit("图 "), "p_name", F.lit("~*.png"))).alias("url"))


def repaired_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see [it]("), F.lit("http://x/"), "p_name", F.lit(" (v"), F.col("p_size"), F.lit(").png \"title\") and ![p](ok%20"), F.col("p_partkey"), F.lit(".png)"))
    return table(spark, sf_dir, "part").select("p_partkey", normalize_link_urls(text).alias("text"))


def tables_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HTML table of each part: a cell over two rows, and a blank value."""
    row = lambda *cells: F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    html = F.concat(F.lit("About<table>"), row(td(F.lit("name")), td(F.lit("field")), td(F.lit("value"))), row(F.lit("<td rowspan=\"2\">"), F.col("p_name"), F.lit("</td>"), td(F.lit("brand")), td(F.col("p_brand"))), row(td(F.lit("size")), td(F.when(F.col("p_size") > 25, F.lit("-")).otherwise(F.col("p_size").cast("string")))), F.lit("</table>end"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type", html.alias("html"))


def tables_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_html(spark, sf_dir).select("p_partkey", linearize_tables(F.col("html")).alias("text"), complex_table(F.col("html")).alias("is_complex"))


def tables_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of each part, of eight kinds: key and value, with header cells, with an empty corner and a wide cell, a deep cell that reaches past the end, one
    table within another, none, cells over thousands of columns, and a blank one over 70,000 rows."""
    k = F.col("p_partkey") % 8
    kinds = [
        "<table><tr><td>name</td><td>{n}</td></tr><tr><td></td><td>{b}</td></tr></table>",
        "<table><tr><th>name</th><th>brand</th></tr><tr><td>{n}</td><td>{b}</td></tr></table>",
        "<table><tr><td></td><td colspan='2'>of {b}</td></tr><tr><td>{n}</td><td>1</td><td>2</td></tr></table>",
        "<table><tr><td>name</td><td>brand</td></tr><tr><td rowspan='11'>{n}</td><td>{b}</td></tr></table>",
        "<table><tr><td>name</td><td>brand</td></tr><tr><td>{n}</td><td><table><tr><td>{b}</td></tr></table></td></tr></table>",
        "{n} of {b}",
        "<table><tr><td>name</td><td colspan='4999'>{n}</td></tr><tr><td>{b}</td><td colspan='4998'>-</td><td>last</td></tr></table>",
        "<table><tr><td>{n}</td><td>{b}</td></tr><tr><td rowspan='70000'></td><td>x</td></tr></table>",
    ]
    html = F.lit(None).cast("string")
    for i, form in enumerate(kinds):
        html = F.when(k == i, F.replace(F.replace(F.lit(form), F.lit("{n}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand"))).otherwise(html)
    rows = table(spark, sf_dir, "part").select("p_partkey", html.alias("html"))
    return rows.select("p_partkey", linearize_tables(F.col("html")).alias("text"), complex_table(F.col("html")).alias("is_complex"))


def pipes_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("| name | brand | size |\n|---|:--|--:|\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" | "), F.when(F.col("p_size") > 25, F.lit("/")).otherwise(F.col("p_size").cast("string")), F.lit(" |\nend"))
    return table(spark, sf_dir, "part").select("p_partkey", linearize_tables(md, always=True).alias("text"))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with one name: plain, fenced, broken, blank."""
    body = F.to_json(F.struct(F.array("p_name").alias("item_names"), F.concat(F.lit("about "), "p_name").alias("rewritten_query")))
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("{"), body)).otherwise(" ")
    reply = parse_extraction(raw, F.lit("original"))
    return table(spark, sf_dir, "part").select("p_partkey", reply.alias("r")).select("p_partkey", F.array_join("r.item_names", ",").alias("names"), "r.rewritten_query")


def web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.array(F.struct(F.concat(F.lit(" "), "url", F.lit(" ")).alias("snippet"), F.lit("a").alias("title"), "url"), F.struct(F.lit(None).cast("string").alias("snippet"), F.lit(" b").alias("title"), F.lit("u").alias("url")))
    body = F.to_json(F.struct(pages.alias("pages")))
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("oops"), body)).otherwise(body)
    return parse_web_results(table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), raw.alias("raw")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.lit(" \t")).otherwise(F.col("text")).alias("query"), F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string")).alias("session_id"))
    ready, rejected = prepare_requests(rows, ["conv_id", "turn"])
    return ready.select("conv_id", "turn", "session_id", "task_id", F.lit("").alias("reason")).unionByName(rejected.select("conv_id", "turn", F.lit("").alias("session_id"), F.lit("").alias("task_id"), "reason"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(" \n\t")).otherwise(F.col("text")).alias("text"))
    ok, blank = valid_inputs(rows, "text")
    return ok.select("doc_id", F.lit("").alias("reason")).unionByName(blank.select("doc_id", "reason"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    said = F.when(k == 1, F.lit(" UNKNOWN\n")).when(k == 2, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k == 3, F.lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", resolve_item_name(said, F.col("p_brand")).alias("item_name"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole tenths below a minute and whole seconds above: halves are written alike everywhere
    seconds = F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 600 / 10).otherwise((F.col("event_id") % 7200 + 60).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", format_duration(seconds).alias("shown"))


QUERIES = {
    "image_alt_texts": alt_texts,
    "normalized_newlines": lines_normalized,
    "used_images": used_images,
    "images_by_ending": by_endings,
    "images_beside_documents": beside_documents,
    "image_contexts": image_contexts,
    "linked_images": linked_images,
    "object_urls": object_urls,
    "repaired_links": repaired_links,
    "html_tables_spoken": tables_spoken,
    "table_kinds": tables_kinds,
    "pipe_tables_spoken": pipes_spoken,
    "extraction_replies": extractions,
    "web_results": web_results,
    "prepared_requests": requests,
    "valid_inputs": inputs,
    "resolved_names": answers,
    "durations": durations,
}

_PICTURES = "g AS (SELECT doc_id, len(string_split(text, chr(10))) AS size, unnest(range((len(string_split(text, chr(10))) - 1) // 3 + 2)) AS n FROM documents WHERE text IS NOT NULL)"
_DOCS = f"""{_PICTURES}, i AS (SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda x, k: CASE WHEN (k - 1) % 3 = 0 THEN '## part ' || (k - 1) || chr(10) || x || chr(10) || '![ alt ' || (k - 1) || ' ](images/pic' || (k - 1) || '_(1).png)' ELSE x END) AS parts,
      string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)"""

SQL = {
    "image_alt_texts": """WITH d AS (SELECT doc_id, source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k: CASE WHEN (k - 1) % 3 = 0 THEN '## part ' || (k - 1) || chr(10) || x || chr(10) || 'alt ' || (k - 1) ELSE x END), chr(10)) AS bare FROM documents WHERE text IS NOT NULL)
SELECT doc_id, bare, coalesce(source, '') || chr(10) || bare AS embedded FROM d""",
    "normalized_newlines": r"SELECT doc_id, replace(replace(replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents",
    "used_images": f"WITH {_PICTURES} SELECT doc_id, 'pic' || (3 * n) || '_(1).png' AS name, size > 3 * n AS used FROM g WHERE n % 5 <> 4",
    "images_by_ending": f"""WITH {_PICTURES}, r AS (SELECT doc_id, 'pic' || (3 * n) || '_(1).png' AS ref FROM g WHERE size > 3 * n)
SELECT doc_id, (3 * n) || '_(1).png' AS name, EXISTS (SELECT 1 FROM r WHERE r.doc_id = g.doc_id AND suffix(ref, (3 * n) || '_(1).png')) AS used FROM g WHERE n % 5 <> 4""",
    "images_beside_documents": f"""WITH {_PICTURES}, i AS (SELECT DISTINCT doc_id % 50 AS folder, doc_id // 50 % 40 * 3 AS k FROM documents)
SELECT doc_id, 'pic' || k || '_(1).png' AS name, 'file:/kb/f' || folder || '/images/pic' || k || '_(1).png' AS path FROM g JOIN i ON folder = doc_id % 50 AND k = 3 * n WHERE size > 3 * n""",
    "image_contexts": f"""WITH {_DOCS}, p AS (SELECT doc_id, n * 3 AS k, array_to_string(parts, chr(10)) AS md, '![ alt ' || (3 * n) || ' ](images/pic' || (3 * n) || '_(1).png)' AS img FROM i JOIN g USING (doc_id) WHERE size > 3 * n AND n % 5 <> 4),
a AS (SELECT *, strpos(md, img) AS spot FROM p)
SELECT doc_id, 'pic' || k || '_(1).png' AS name, regexp_replace(list_last(regexp_extract_all(substr(md, 1, spot - 1), '(?m)^#{{1,6}}\\s+[^\\n]+')), '\\s+$', '') AS heading, substr(md, greatest(1, spot - 200), least(200, spot - 1)) AS up_text, substr(md, spot + length(img), 200) AS down_text FROM a""",
    "linked_images": """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k: CASE WHEN (k - 1) % 3 = 0 THEN '## part ' || (k - 1) || chr(10) || x || chr(10) ||
  CASE WHEN k - 1 = 3 OR (k - 1) // 3 % 5 = 4 THEN '![ alt ' || (k - 1) || ' ](images/pic' || (k - 1) || '_(1).png)' ELSE '![about pic' || (k - 1) || '_(1).png](http://store/kb/' || doc_id || '/pic' || (k - 1) || '_%281%29.png)' END ELSE x END), chr(10)) AS md_content FROM documents WHERE text IS NOT NULL""",
    "object_urls": "SELECT p_partkey, 'http://store/kb/' || replace(p_brand, '#', '%23') || '%20%28A%29/%E5%9B%BE%20' || replace(p_name, ' ', '%20') || '~%2A.png' AS url FROM part",
    "repaired_links": """SELECT p_partkey, 'see [it](http://x/' || replace(p_name, ' ', '%20') || '%20%28v' || p_size || '%29.png "title") and ![p](ok%20' || p_partkey || '.png)' AS text FROM part""",
    "html_tables_spoken": """SELECT p_partkey, 'About' || chr(10) || chr(10) || '- 【' || p_name || '】(对应name)：field为brand，value为' || p_brand || '。' || chr(10) || '- 【' || p_name || '】(对应name)：field为size' || CASE WHEN p_size > 25 THEN '' ELSE '，value为' || p_size END || '。' || chr(10) || chr(10) || 'end' AS text, false AS is_complex FROM part""",
    "table_kinds": """WITH p AS (SELECT p_partkey, p_partkey % 8 AS k, p_name AS n, p_brand AS b, chr(10) AS nl FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN nl || nl || '- 【name】：' || n || '。' || nl || '- 【未知属性】：' || b || '。' || nl || nl
                         WHEN 1 THEN nl || nl || '- 【' || n || '】(对应name)：brand为' || b || '。' || nl || nl
                         WHEN 2 THEN nl || nl || '- 【' || n || '】：of ' || b || '为1，of ' || b || '为2。' || nl || nl
                         WHEN 3 THEN nl || nl || '- 【name】：brand。' || nl || '- 【' || n || '】：' || b || '。' || repeat(nl || '- 【' || n || '】：无。', 10) || nl || nl
                         WHEN 4 THEN nl || nl || '- 【' || n || '】(对应name)：brand为' || b || '，属性2为' || b || '。' || nl || '- 【' || b || '】' || nl || nl || '</td></tr></table>'
                         WHEN 5 THEN n || ' of ' || b
                         WHEN 6 THEN nl || nl || '- 【' || b || '】(对应name)：' || n || '为last。' || nl || nl
                         WHEN 7 THEN nl || nl || '- 【' || n || '】：' || b || '。' || nl || '- 【未知属性】：x。' || nl || nl END AS text, k IN (3, 4, 7) AS is_complex FROM p""",
    "pipe_tables_spoken": """SELECT p_partkey, chr(10) || chr(10) || '- 【' || p_name || '】(对应name)：brand为' || p_brand || CASE WHEN p_size > 25 THEN '' ELSE '，size为' || p_size END || '。' || chr(10) || chr(10) || 'end' AS text FROM part""",
    "extraction_replies": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_name ELSE '' END AS names, CASE WHEN p_partkey % 4 < 2 THEN 'about ' || p_name ELSE 'original' END AS rewritten_query FROM part",
    "web_results": "SELECT page_id AS request_id, 0 AS pos, url AS snippet, 'a' AS title, url FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 1, '', 'b', 'u' FROM pages WHERE page_id % 3 <> 0",
    "prepared_requests": """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 OR NOT regexp_matches(text, '\\S') THEN '' WHEN turn % 2 = 0 THEN conv_id::VARCHAR ELSE sha256('session' || chr(31) || conv_id || chr(31) || turn) END AS session_id,
       CASE WHEN turn % 3 = 2 OR NOT regexp_matches(text, '\\S') THEN '' ELSE sha256('task' || chr(31) || conv_id || chr(31) || turn) END AS task_id, CASE WHEN turn % 3 = 2 OR NOT regexp_matches(text, '\\S') THEN 'blank query' ELSE '' END AS reason FROM conversations""",
    "valid_inputs": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR text IS NULL OR NOT regexp_matches(text, '\\S') THEN 'blank text' ELSE '' END AS reason FROM documents",
    "resolved_names": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN p_name ELSE p_brand END AS item_name FROM part",
    "durations": """WITH d AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 600 / 10 ELSE (event_id % 7200 + 60)::DOUBLE END AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) ELSE printf('%dm%.0fs', floor(s / 60)::INT, s - floor(s / 60) * 60) END AS shown FROM d""",
}
