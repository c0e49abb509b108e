"""Documents that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..functions.encoders import HashedTokens
from ..functions.text import is_blank
from ..plans.ingest import ingest_reported
from ..plans.store import once
from ..schemas import CHUNKS
from ..sources.files import file_stem, write_chunk_batch

FILES = "path string, modificationTime timestamp, length long, content binary"
REJECTED = "path string, doc_id long, chunk_no int, reason string"
COMMITS = "chunks long, rejected long"


def rejected_folder(out_dir: str) -> str:
    return out_dir.rstrip("/") + "-rejected"


def commit_folder(out_dir: str) -> str:
    return out_dir.rstrip("/") + "-commits"


def is_committed(spark: SparkSession, out_dir: str, batch: int) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{commit_folder(out_dir)}/batch={batch}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def file_batch(files: DataFrame, out_dir: str, batch: int, config: Config = DEFAULT, encoder=HashedTokens, most_bytes: int = 256 << 20) -> None:
    """One batch of files (path, percent-encoded; length; content) as chunks; each file stands for itself.

    A file over ``most_bytes``, which isn't read, one that isn't UTF-8, a blank one, and what can't be cut or embedded go to the folder of rejected files with a
    reason; nothing of that stops the others. Chunks and rejected files are written to folders of the batch, then its commit; a batch that is repeated is left
    alone if it was committed and else overwrites what it had written.
    """
    spark = files.sparkSession
    if is_committed(spark, out_dir, batch):
        return
    text = files.select("path", "length", F.when(F.col("length") <= most_bytes, F.col("content").cast("string")).alias("md_content"))
    reason = F.when(F.col("length") > most_bytes, "too large").when(~F.is_valid_utf8("md_content"), "not UTF-8").when(is_blank(F.col("md_content")), "blank text")
    # files are read twice: for what each of them is, and for the texts that are cut
    known = once(text.select("path", F.xxhash64("path").alias("doc_id"), reason.alias("reason")))
    named = file_stem(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))))
    docs = text.filter(reason.isNull()).select(F.xxhash64("path").alias("doc_id"), named.alias("file_title"), "md_content")
    chunks, failed = ingest_reported(docs, docs.select("doc_id", F.lit(None).cast("string").alias("answer")).limit(0), config, encoder)
    whole_file = known.filter("reason is not null").select("path", "doc_id", F.lit(None).cast("int").alias("chunk_no"), "reason")
    part = failed.join(known.select("path", "doc_id"), "doc_id").select("path", "doc_id", "chunk_no", "reason")
    rejected = f"{rejected_folder(out_dir)}/batch={batch}"
    whole_file.unionByName(part).write.mode("overwrite").parquet(rejected)
    write_chunk_batch(chunks, out_dir, str(batch))
    counts = spark.read.schema(CHUNKS).parquet(f"{out_dir}/batch={batch}").agg(F.count("*").alias("chunks")).crossJoin(spark.read.schema(REJECTED).parquet(rejected).agg(F.count("*").alias("rejected")))  # one row each
    counts.write.mode("overwrite").parquet(f"{commit_folder(out_dir)}/batch={batch}")


def committed(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected files) of the batches that were committed. The semi-join is on the folders' own column, so that other folders aren't read."""
    done = spark.read.schema(COMMITS).parquet(commit_folder(out_dir)).select("batch")
    rows = lambda schema, path: spark.read.schema(schema).parquet(path).join(done, "batch", "left_semi").drop("batch")
    return rows(CHUNKS, out_dir), rows(REJECTED, rejected_folder(out_dir))


def small_files(spark: SparkSession) -> SparkSession:
    """A session with the same settings, but that a task reads hundreds of small files, not four, and lists many, not one. A stream's source keeps to its session."""
    own = spark.newSession()
    wanted = {"spark.sql.files.openCostInBytes": str(64 << 10), "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(8 * spark.sparkContext.defaultParallelism)}
    for k, v in {**spark.conf.getAll, **wanted}.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


def ingest_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, config: Config = DEFAULT, trigger: dict | None = None, encoder=HashedTokens, most_bytes: int = 256 << 20, pattern: str = "*.md", files_per_batch: int | None = None) -> StreamingQuery:
    """Each new Markdown file becomes chunks in ``out_dir``, or a rejected file beside it (``committed`` reads both). Batches are whole files, so the batch job runs on
    them as it is."""
    source = small_files(spark).readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def batch(df: DataFrame, epoch: int) -> None:
        file_batch(df, out_dir, epoch, config, encoder, most_bytes)

    files = source.load(in_dir).select(F.col("_metadata.file_path").alias("path"), "length", "content")
    # the filter reaches the reader, which then leaves the content of large files alone
    sized = files.filter(F.col("length") <= most_bytes).unionByName(files.filter(F.col("length") > most_bytes).withColumn("content", F.lit(None).cast("binary")))
    return sized.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
