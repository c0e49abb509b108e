"""Reading documents and images from folders, and the tables the jobs write."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DEFAULT
from ..operators.images import references
from ..schemas import CHUNKS, ITEM_NAMES, MESSAGES


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", "")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, file_title, kind, md_content): a row per file; the id follows from the path."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("md_content"), F.col("_metadata.file_path").alias("path"))
    return text.select(F.xxhash64("path").alias("doc_id"), "path", file_stem(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))).alias("file_title"), F.lit("md").alias("kind"), "md_content")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(Markdown files, PDF files, rejected ones with a reason) by the ending of their path."""
    kind = extension(F.col("path"))
    rejected = files.filter(~kind.isin("md", "pdf")).withColumn("reason", F.concat(F.lit("unsupported file type: "), kind))
    return files.filter(kind == "md"), files.filter(kind == "pdf"), rejected


def list_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = DEFAULT.image_extensions) -> DataFrame:
    """(path, name) of the image files below a folder."""
    files = list_files(spark, root).filter(extension(F.col("path")).isin(*extensions))
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


def folder(path: Column) -> Column:
    """A path without its last part and without what names its file system."""
    return F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), r"^\w+:/*", "/")


def images_of(images: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, name, path): the images beside each document, that is in the folder ``images`` of its own folder. ``docs``: doc_id, path. Documents of one folder
    share its images: this is every document with every image of its folder; ``referenced_images`` gives only those that a document's text asks for."""
    return homed(images).join(docs.select("doc_id", home_of(F.col("path")).alias("home")), "home").select("doc_id", "name", "path")


def home_of(path: Column) -> Column:
    """The folder of a document whose path is percent-encoded."""
    return folder(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def homed(images: DataFrame) -> DataFrame:
    """``images`` that lie in a folder ``images``, with that folder's own folder as ``home``."""
    at = folder(F.col("path"))
    return images.withColumn("home", F.when(at.endswith("/images"), F.regexp_replace(at, "/images$", ""))).filter("home is not null")


def referenced_images(images: DataFrame, docs: DataFrame, by_suffix: bool = False) -> DataFrame:
    """(doc_id, name, path): the images beside each document that its text refers to. ``docs``: doc_id, path, md_content. The names in the texts come first and meet the
    images on folder and name, so a folder of many documents and images gives as many rows as there are references. With ``by_suffix`` an address counts
    that ends in an image's name; the endings have the lengths that occur among the folder's names."""
    at = docs.select("doc_id", home_of(F.col("path")).alias("home"))
    asked = references(docs).select("doc_id", "name").distinct().join(at, "doc_id")
    there = homed(images)
    if by_suffix:
        sizes = there.groupBy("home").agg(F.collect_set(F.length("name")).alias("sizes"))
        n = F.length("name")
        ends = F.transform(F.filter("sizes", lambda k: k <= n), lambda k: F.substr(F.col("name"), n - k + 1, k))
        asked = asked.join(sizes, "home").select("doc_id", "home", F.explode(ends).alias("name")).distinct()
    return asked.join(there, ["home", "name"]).select("doc_id", "name", "path")


def write_text_files(texts: DataFrame, path: str, folders: int = 128) -> None:
    """Each name's texts (name, text), a line each, as a file ``name.txt`` in one of some folders: a folder for each file takes far longer to list than to read. Tasks
    write the files; one that is repeated writes the same again."""
    there, whole = pafs.FileSystem.from_uri(path)
    there.create_dir(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        at, out = None, None
        for batch in batches:
            for folder, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (folder, name):
                    if out is not None:
                        out.close()
                    if at is None or at[0] != folder:
                        fs.create_dir(f"{root}/{folder}")
                    at, out = (folder, name), fs.open_output_stream(f"{root}/{folder}/{name}.txt")
                out.write(((text or "") + "\n").encode())
        if out is not None:
            out.close()
        yield from ()

    rows = texts.select(F.pmod(F.xxhash64("name"), F.lit(folders)).alias("folder"), F.coalesce("name", F.lit("null")).alias("name"), "text")
    rows.repartition(folders, "folder").sortWithinPartitions("folder", "name").mapInArrow(run, "files long").count()


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON has text keys only, so token ids are cast back."""
    rows = spark.read.schema(CHUNKS.replace("map<long,", "map<string,")).json(path)
    return rows.withColumn("sparse_vector", F.transform_keys("sparse_vector", lambda k, _: k.cast("long")))


def write_chunk_batch(chunks: DataFrame, path: str, batch: str) -> None:
    """The chunks of one batch of documents in a folder of their own, ``batch=...``, which a repeated batch overwrites."""
    chunks.repartition(F.col("item_name"), F.pmod(F.col("chunk_id"), F.lit(8))).sortWithinPartitions("item_name").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_chunks(chunks: DataFrame, path: str, mode: str = "append", dedupe: bool = False) -> None:
    """Append or overwrite, rows of one item name near each other, which is what searches filter on. ``dedupe`` leaves out ids that are there already. A
    hot name is spread over several files by the chunk id."""
    if dedupe and mode == "append":
        there = chunks.sparkSession.read.schema(CHUNKS).parquet(path).select("chunk_id")
        chunks = chunks.join(there, "chunk_id", "left_anti")
    chunks.repartition(F.col("item_name"), F.pmod(F.col("chunk_id"), F.lit(8))).sortWithinPartitions("item_name").write.mode(mode).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def write_item_names(names: DataFrame, path: str) -> None:
    names.write.mode("append").parquet(path)


def read_item_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM_NAMES).parquet(path)


def archive_originals(files: DataFrame, path: str, at: str = "ts") -> None:
    """Files under the date they came in, ``dt=yyyyMMdd``."""
    files.withColumn("dt", F.date_format(at, "yyyyMMdd")).write.mode("append").partitionBy("dt").parquet(path)


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    messages.withColumn("dt", F.date_format(F.timestamp_seconds("ts"), "yyyyMMdd")).write.mode(mode).partitionBy("dt").parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGES).parquet(path)
