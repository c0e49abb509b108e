"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.llm.line_dedup import line_dedup
from lorewell.llm.mixing import apply_mix, mix
from lorewell.llm.ngram_join import Rule, ngram_join
from lorewell.llm.packing import pack_documents
from lorewell.llm.toxicity import toxicity
from lorewell.llm.work import drop, numbered, read_table, squeezed, stored, tables_made


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its own columns of these names called otherwise, and what gives an operator's result the columns of ``docs`` again."""
    held = {n: f"_own_{n}" for n in names if n in docs.columns}
    return docs.withColumnsRenamed(held), lambda df: df.drop(*held).withColumnsRenamed({v: k for k, v in held.items()}).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go; those whose text is null or blank stay. Rows are judged by their text alone, so repeated rows, null
    ids and repeated ids share the fate of equal texts. An empty table stays empty."""
    own, back = aside(docs, "score", "held_out", "predicted")
    return back(toxicity(own, read_table(spark, sf_dir, "labels")).filter((F.col("predicted") == 0) | (squeezed(F.col("text")) == "")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that stand in five documents or more stay in one of them only, the one with the
    largest id. Every document stays, emptied or not; a null text stays null. Rows that repeat an id count as one document, and rows without id are left as
    they are."""
    own, back = aside(docs, "kept_text", "n_lines", "n_dropped")
    cleaned = line_dedup(own, min_docs=5, min_chars=40)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return back(cleaned.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a word-shingle similarity of 0.8 the one with the smallest id stays, null last.

    Each row is a document of its own, whatever its id: of rows that repeat an id and a text one stays, and rows without id are compared like
    others. Texts without words are linked with nothing; of those with one id one stays, and all without id.
    """
    rows, row = numbered(docs, "near-rows")
    found = ngram_join(rows, Rule(width=5, num=80, den=100), id_col=row).withColumnRenamed("doc_id", row).join(rows.select(row, "doc_id"), row)
    wordless = F.col("n_shingles") == 0
    group = (F.when(~wordless | F.col("doc_id").isNull(), F.col("component_id")).alias("a"), F.when(wordless, F.col("doc_id")).alias("b"))
    first = found.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row)).select(row)
    return rows.join(first, row, "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, the last one of a source in part. Each row is a document of its own: null and repeated ids and
    equal rows are taken like others; of equal rows any may be the one in part. Rows without words go, since a source's target is in words."""
    rows, row = numbered(docs, "mix-rows")
    return apply_mix(rows, mix(rows, row_col=row), row).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place. Each row is a document of its own; a null or empty text is its end id alone."""
    return pack_documents(docs, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. When a stage's result stands, the one before it and all tables that it was made from are deleted; what stays is what the result reads."""
    docs = read_table(spark, sf_dir, "documents")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        with tables_made() as made:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(*before, *(t for t in made if t is not docs))
        before = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop(*before)  # the pieces of all documents are written by now
    return packed
