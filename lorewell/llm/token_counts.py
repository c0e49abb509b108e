"""Tokens per document of flat token files, by a scan for the end-of-document identifier.

A flat file is nothing but ids, one document after the other, each closed by the separator: no index, no lengths. It is read in blocks that
pay no heed to document borders. Each task finds all separators of its blocks at once (one vectorised comparison) and reports the runs
between them. A document may reach over any number of blocks: the separators before a block (a prefix sum in two levels, over blocks and over
groups of blocks) give the number of the document each run belongs to, and only the first and last run of a block are added up across blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tokens import SPECIAL_ID, default_path, encode
from .work import make_folder, own_dir, read_table, stored

BLOCK_TOKENS = 1 << 17


def read_token_files(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, names: DataFrame | None = None) -> DataFrame:
    """(file, block, start, data) of the files in a folder, ``file`` being the last part of the path. Spark lists them; tasks read byte ranges, so a file's size
    doesn't matter. ``names`` (file) leaves out all others."""
    width = np.dtype(dtype).itemsize
    step = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length").filter("length > 0")
    if names is not None:
        files = files.join(names, "file", "left_semi")
    ranges = files.select("path", "file", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("block", "at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for where, file, block, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                system, name = fs.FileSystem.from_uri(where)
                with system.open_input_file(name) as f:
                    f.seek(at)
                    data = f.read(step)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([at // width], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "start", "data"])

    return ranges.repartition("file", "block").mapInArrow(read, "file string, block long, start long, data binary")


def scan_blocks(blocks: DataFrame, end_id: int, dtype: str) -> DataFrame:
    """One row per run of ids without separator: (file, block, run, start, n_tokens, last). A block has one run more than separators."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "run", "start", "n_tokens", "last"]
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(3)[i].as_buffer(), dtype)
                ends = np.flatnonzero(ids == end_id)
                begin = np.r_[0, ends + 1]
                n = np.r_[ends, len(ids)] - begin
                k = len(n)
                start = begin + batch.column(2)[i].as_py()
                file, block = batch.column(0)[i], batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * k, file.type), pa.array(np.full(k, block)), pa.array(np.arange(k)), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.arange(k) == k - 1)], names)

    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", "block", "start", "data").filter("data is not null").mapInArrow(scan, f"file {kind}, block long, run long, start long, n_tokens long, last boolean")


def count_tokens(blocks: DataFrame, end_id: int, dtype: str = "<u2", blocks_per_group: int = 4096) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed): each document of each file in order, from 0, with its place and its ids without the separator.

    ``blocks``: file, block (0, 1, ... in order; gaps are allowed), start (the block's place in its file, in ids), data. Empty documents count
    0. Ids behind the last separator are a document with closed = false; nothing behind it is none. A file without ids gives no row. Files
    with null data blocks are read without those. Further columns are ignored.
    """
    runs = stored(scan_blocks(blocks, end_id, dtype), "token-runs")
    per_block = runs.filter("last").select("file", "block", F.col("run").alias("ends"), F.floor(F.col("block") / blocks_per_group).alias("lot"))
    lots = per_block.groupBy("file", "lot").agg(F.sum("ends").alias("lot_ends"))
    lots = lots.select("file", "lot", F.coalesce(F.sum("lot_ends").over(Window.partitionBy("file").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lot_before"))
    inner = F.coalesce(F.sum("ends").over(Window.partitionBy("file", "lot").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = per_block.withColumn("inner", inner).join(lots, ["file", "lot"]).select("file", "block", (F.col("lot_before") + F.col("inner")).alias("ahead"))
    placed = runs.join(ahead, ["file", "block"]).withColumn("ordinal", F.col("ahead") + F.col("run"))
    inside = placed.filter("run > 0 and not last").select("file", "ordinal", "start", "n_tokens", F.lit(True).alias("closed"))
    edges = placed.filter("run = 0 or last").groupBy("file", "ordinal").agg(F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.max(~F.col("last")).alias("closed"))
    return inside.unionByName(edges.filter("closed or n_tokens > 0"))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Tokenise documents into flat files of 16-bit ids in ``folder``, one per input partition. Returns, stored, which document stands where: (file, ordinal,
    doc_id); a file that isn't named there was left by a task that failed.

    Every row is a document of its own, whatever its id: null and repeated ids pass through. A null text counts as empty and is its separator alone. The
    special token's string is ordinary text, so no id inside a document is the separator. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)
        file, ordinal = f"{context.partitionId():06d}-{context.taskAttemptId()}.bin", 0
        with system.open_output_stream(f"{base}/{file}") as out:
            for batch in batches:
                for text in batch.column(1):
                    out.write(np.array([*encode(text.as_py(), vocabulary, special_as_text=True), end_id], dtype="<u2").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], ["file", "ordinal", "doc_id"])
                ordinal += n

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "file string, ordinal long, doc_id long"), "token-order")


def token_counts(docs: DataFrame, vocabulary: str, end_id: int = SPECIAL_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal, start, closed), one row per document: its ids as the scan of the flat files finds them. An empty table gives an empty
    result."""
    spark = docs.sparkSession
    folder = f"{own_dir(spark)}/token-files-{uuid.uuid4().hex}"
    make_folder(spark, folder)
    order = write_token_files(docs, folder, vocabulary, end_id)
    counts = count_tokens(read_token_files(spark, folder, block_tokens=block_tokens, names=order.select("file").distinct()), end_id)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start", "closed")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat files of 16-bit ids, then the ids of each document as the scan finds them."""
    return token_counts(read_table(spark, sf_dir, "documents"), default_path())
