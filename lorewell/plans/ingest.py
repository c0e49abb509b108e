"""Files -> chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config
from ..functions.encoders import HashedTokens
from ..functions.tables import complex_table
from ..functions.text import embedding_input, is_blank, object_url, resolve_item_name
from ..operators.images import image_context, match_images, replace_image_links
from ..operators.items import item_name_context
from ..operators.sections import chunk_sections, split_by_headings
from ..operators.vectors import embed
from .store import once


def chunk_documents(docs: DataFrame, summaries: DataFrame | None = None, config: Config = DEFAULT, keep: tuple[str, ...] = (), report: bool = False) -> DataFrame:
    """(doc_id, file_title, md_content, ..) -> chunks, with those columns of the document that ``keep`` names. One exchange, of the lines by document. ``report``: see
    ``chunk_sections``."""
    if summaries is not None:
        docs = replace_image_links(docs, summaries)
    return chunk_sections(split_by_headings(docs, keep), config, keep, report)


def name_documents(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """``docs`` (doc_id, file_title, ..) with item_name: each document's name from the reply table (doc_id, answer), or its title. Of several replies the last in
    alphabetical order counts."""
    said = replies.groupBy("doc_id").agg(F.max("answer").alias("_answer"))
    return docs.join(said.hint("shuffle_hash"), "doc_id", "left").withColumn("item_name", resolve_item_name(F.col("_answer"), F.col("file_title"))).drop("_answer")


def embed_chunks(chunks: DataFrame, encoder=HashedTokens) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors and an id that a repeated run gives again, rejected chunks with a reason: blank text, or no vectors where the encoder failed)."""
    rows = chunks.withColumn("_input", embedding_input(F.col("item_name"), F.col("content")))
    blank = is_blank(F.col("_input"))
    done = embed(rows.filter(~blank), "_input", encoder).drop("_input").withColumn("chunk_id", F.xxhash64("doc_id", "chunk_no"))
    whole = F.coalesce((F.size("dense_vector") > 0) & (F.size("sparse_vector") > 0), F.lit(False))
    failed = done.filter(~whole).select(*chunks.columns, F.lit("no vectors").alias("reason"))
    return done.filter(whole), rows.filter(blank).select(*chunks.columns, F.lit("blank text").alias("reason")).unionByName(failed)


def ingest(docs: DataFrame, replies: DataFrame, summaries: DataFrame | None = None, config: Config = DEFAULT, encoder=HashedTokens) -> DataFrame:
    """The chunk table of a set of documents, ready to be written. The name is joined to the document, before it is cut: nothing is joined to chunks, and the exchange
    of that join serves the cutting too."""
    named = name_documents(docs.select("doc_id", "file_title", "md_content"), replies)
    return embed_chunks(chunk_documents(named, summaries, config, ("item_name",)), encoder)[0].select("chunk_id", "doc_id", "chunk_no", "title", "content", "file_title", "parent_title", "item_name", "dense_vector", "sparse_vector")


def ingest_reported(docs: DataFrame, replies: DataFrame, config: Config = DEFAULT, encoder=HashedTokens) -> tuple[DataFrame, DataFrame]:
    """(chunk table, (doc_id, chunk_no, reason)): as ``ingest``, but what can't be cut or embedded is reported in the second table and stops nothing. Computed
    once, for both."""
    named = name_documents(docs.select("doc_id", "file_title", "md_content"), replies)
    rows = chunk_documents(named, None, config, ("item_name",), report=True)
    rows = rows.withColumn("_input", F.when(F.col("error").isNull(), embedding_input(F.col("item_name"), F.col("content"))))
    done = once(embed(rows, "_input", encoder, retry=True).drop("_input"))
    whole = F.coalesce((F.size("dense_vector") > 0) & (F.size("sparse_vector") > 0), F.lit(False)) & F.col("error").isNull()
    chunks = done.filter(whole).select(F.xxhash64("doc_id", "chunk_no").alias("chunk_id"), "doc_id", "chunk_no", "title", "content", "file_title", "parent_title", "item_name", "dense_vector", "sparse_vector")
    return chunks, done.filter(~whole).select("doc_id", "chunk_no", F.coalesce("error", F.lit("no vectors")).alias("reason"))


def image_requests(docs: DataFrame, images: DataFrame, config: Config = DEFAULT, by_suffix: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, path, heading, up_text, down_text) of the images that documents refer to, for a model to summarise, and the images they don't."""
    used, unused = match_images(docs, images, by_suffix)
    return used.join(image_context(docs, used, config, by_suffix), ["doc_id", "name"]), unused


def image_links(used: DataFrame, summaries: DataFrame, docs: DataFrame, base: str, bucket: str) -> DataFrame:
    """(doc_id, name, summary, url): what ``chunk_documents`` puts in the place of an image. ``summaries``: doc_id, name, summary; an image without one has its
    name for it. The address is that of the stored copy, under the document's title."""
    rows = used.select("doc_id", "name").join(summaries.select("doc_id", "name", "summary"), ["doc_id", "name"], "left").join(docs.select("doc_id", "file_title"), "doc_id")
    return rows.select("doc_id", "name", F.coalesce("summary", "name").alias("summary"), object_url(F.lit(base), F.lit(bucket), F.col("file_title"), F.col("name")).alias("url"))


def tables_to_review(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks as they can go on, chunks with a nested or very deep table, for a model or a person to read)."""
    marked = chunks.withColumn("_complex", complex_table(F.col("content")))
    return marked.filter("not _complex").drop("_complex"), marked.filter("_complex").drop("_complex")


def naming_contexts(chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, context): what a model is shown to name the documents."""
    return item_name_context(chunks, config)
