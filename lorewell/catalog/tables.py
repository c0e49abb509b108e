"""The tables that jobs write, written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..plans.buckets import append_new, chunks_table, read_buckets
from ..plans.store import new_folder
from ..sources.files import archive_originals, read_chunks, read_chunks_json, read_item_names, read_messages, write_chunk_batch, write_chunks, write_chunks_json, write_item_names, write_messages, write_text_files
from ..streaming.files import committed, file_batch, ingest_stream
from .base import table
from .chats import messages
from .segments import SECTIONS, marked, merged_sql, plain_chunks


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section chunks with an id, a name and vectors that SQL can restate."""
    rows = plain_chunks(spark, sf_dir).withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("chunk_no"))
    n = F.length("content")
    return rows.select(
        "chunk_id", "doc_id", "chunk_no", "title", "content", "file_title", "parent_title",
        F.concat(F.lit("item "), F.col("doc_id") % 50).alias("item_name"),
        F.array(n.cast("float"), F.lit(0.5).cast("float")).alias("dense_vector"),
        F.create_map(n.cast("long"), F.lit(1.5).cast("float"), F.lit(-1).cast("long"), F.lit(0.25).cast("float")).alias("sparse_vector"),
    )


def shown(chunks: DataFrame) -> DataFrame:
    weight = F.aggregate(F.map_entries("sparse_vector"), F.lit(0.0), lambda s, e: s + e["key"] * e["value"].cast("double"))
    return chunks.select("chunk_id", "doc_id", "chunk_no", "title", "content", "item_name", F.element_at("dense_vector", 1).cast("double").alias("first"), weight.alias("weight"))


def chunks_by_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark)}/rows"
    write_chunks_json(chunk_rows(spark, sf_dir), path)
    return shown(read_chunks_json(spark, path))


def chunks_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of even documents written first, then all of them, those already there left out."""
    path, rows = f"{new_folder(spark)}/rows", chunk_rows(spark, sf_dir)
    write_chunks(rows.filter("doc_id % 2 = 0"), path)
    write_chunks(rows, path, dedupe=True)
    return shown(read_chunks(spark, path))


def chunks_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in a table of buckets by chunk id, of which the second write reads the ids alone."""
    kept, rows = chunks_table(f"{new_folder(spark)}/chunks", 8), chunk_rows(spark, sf_dir)
    append_new(rows.filter("doc_id % 2 = 0"), kept)
    append_new(rows, kept)
    return shown(read_buckets(spark, kept))


def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of documents, one of them written twice, as after a failure."""
    path, rows = f"{new_folder(spark)}/rows", chunk_rows(spark, sf_dir)
    for k in (0, 1, 1, 2):
        write_chunk_batch(rows.filter(F.pmod("doc_id", F.lit(3)) == k), path, str(k))
    return shown(read_chunks(spark, path))


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark)}/rows"
    rows = chunk_rows(spark, sf_dir).filter("chunk_no = 0")
    write_item_names(rows.select("doc_id", "file_title", "item_name", "dense_vector", "sparse_vector"), path)
    return read_item_names(spark, path).select("doc_id", "file_title", "item_name", F.size("dense_vector").alias("dim"))


def messages_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages under the days of their times, a day for each turn."""
    path = f"{new_folder(spark)}/rows"
    write_messages(messages(spark, sf_dir).withColumn("ts", F.col("ts") * 86_400), path)
    days = spark.read.parquet(path).select("message_id", F.col("dt").cast("string").alias("dt"))
    return read_messages(spark, path).select("message_id", "session_id", "role", "text", "ts").join(days, "message_id")


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as originals, each of a day that its id gives."""
    path = f"{new_folder(spark)}/rows"
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.timestamp_seconds(F.col("doc_id") % 30 * 86_400).alias("ts"))
    archive_originals(rows, path)
    return spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


def arrived_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Markdown file that a stream takes in, those over 10,000 bytes being too large; the first batch comes twice. Per file: its chunks, or why it
    was rejected. Sections are never split here, which SQL couldn't restate."""
    source, out, state = (f"{new_folder(spark)}/rows" for _ in range(3))
    write_text_files(marked(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.col("md_content").alias("text")), source)
    config = Config(max_content_length=10**9)
    ingest_stream(spark, source, out, state, config, most_bytes=10_000, pattern="*.txt", files_per_batch=50_000).awaitTermination()
    # the driver lists what is read: a tenth of the files would show if the batch were taken in again
    again = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*0.txt").load(source).select(F.col("_metadata.file_path").alias("path"), "length", "content")
    file_batch(again, out, 0, config, most_bytes=10_000)
    chunks, rejected = committed(spark, out)
    # a file's name is the document's number, and the title of its chunks
    sizes = chunks.groupBy(F.col("file_title").try_cast("long").alias("file")).agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
    none = F.lit(None).cast("long")
    why = rejected.select(F.regexp_extract("path", r"/([^/]*)\.txt$", 1).try_cast("long").alias("file"), none.alias("chunks"), none.alias("chars"), "reason")
    return sizes.withColumn("reason", F.lit(None).cast("string")).unionByName(why)


QUERIES = {
    "arrived_files": arrived_files,
    "chunks_by_json": chunks_by_json,
    "chunks_appended": chunks_appended,
    "chunks_kept": chunks_kept,
    "chunk_batches": chunk_batches,
    "item_name_table": item_names,
    "stored_messages": messages_kept,
    "archived_originals": archived,
}


_ROWS = f"WITH {SECTIONS} SELECT doc_id * 100000 + chunk_no AS chunk_id, doc_id, chunk_no, title, content, 'item ' || (doc_id % 50) AS item_name, length(content)::DOUBLE AS first, length(content) * 1.5::DOUBLE - 0.25::DOUBLE AS weight FROM chunks"

SQL = {
    "arrived_files": f"""WITH RECURSIVE {SECTIONS}, {merged_sql(10**9)},
x AS (SELECT doc_id, grp, length('## ' || string_agg(title, ' / ') || chr(10) || chr(10)) + length(string_agg(body, chr(10) || chr(10))) AS n FROM r JOIN o USING (doc_id, k) GROUP BY doc_id, grp),
b AS (SELECT doc_id, sum(strlen(line) + 1) AS bytes FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
      LATERAL (SELECT CASE WHEN i % 5 = 0 AND regexp_matches(l, '\\S') THEN repeat('#', (1 + (i // 5) % 3)::INT) || ' ' || l ELSE l END AS line) GROUP BY doc_id)
SELECT doc_id AS file, CASE WHEN bytes <= 10000 THEN count(grp) END AS chunks, CASE WHEN bytes <= 10000 THEN sum(n)::BIGINT END AS chars, CASE WHEN bytes > 10000 THEN 'too large' WHEN count(grp) = 0 THEN 'blank text' END AS reason
FROM b LEFT JOIN x USING (doc_id) GROUP BY doc_id, bytes""",
    "chunks_by_json": _ROWS,
    "chunks_appended": _ROWS,
    "chunks_kept": _ROWS,
    "chunk_batches": _ROWS,
    "item_name_table": f"WITH {SECTIONS} SELECT doc_id, file_title, 'item ' || (doc_id % 50) AS item_name, 2 AS dim FROM chunks WHERE chunk_no = 0",
    "stored_messages": "SELECT conv_id || '-' || printf('%03d', turn) AS message_id, conv_id::VARCHAR AS session_id, role, text, turn * 86400::DOUBLE AS ts, strftime(DATE '1970-01-01' + turn::INT, '%Y%m%d') AS dt FROM conversations",
    "archived_originals": "SELECT strftime(DATE '1970-01-01' + (doc_id % 30)::INT, '%Y%m%d') AS dt, count(*) AS files, sum(length(text))::BIGINT AS chars FROM documents GROUP BY doc_id % 30",
}
