"""Shared-folder tables that cut lineage between the steps of a job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: The ASCII blanks that the text rules of this package mean by white space.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that one side of a join may have to be broadcast, as ``small`` counts them; the driver builds it, so it must fit there with room to spare.
BROADCAST_BYTES = 32 << 20

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_rows: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()
_marked: set[str] = set()
_scopes: list[list[DataFrame]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, local mode gets a temporary one and a cluster an error."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lorewell-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared one. What is left in it goes when the driver ends."""
    path = f"{shared_dir(spark)}/lorewell-{spark.sparkContext.applicationId}"
    if path not in _marked:
        _marked.add(path)
        make_folder(spark, path)
        at, fs = _hadoop(spark, path)
        fs.deleteOnExit(at)
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    at, fs = _hadoop(spark, path)
    fs.mkdirs(at)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lost executor re-reads files instead of recomputing. The rows are counted on the way
    (``row_count``). ``drop`` takes a table away as soon as the next one stands."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back], _rows[back] = path, seen.get["rows"]
    for tables in _scopes:
        tables.append(back)
    return back


def row_count(table: DataFrame) -> int:
    """The rows of a stored table, as they were written."""
    return _rows[table]


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables stored inside of a ``with`` block, also by what it calls, for ``drop``."""
    tables: list[DataFrame] = []
    _scopes.append(tables)
    try:
        yield tables
    finally:
        _scopes[:] = [x for x in _scopes if x is not tables]


def drop(*tables: DataFrame) -> None:
    """Delete stored tables; those that were deleted before are passed over. Nothing that is still to be computed may read them."""
    for t in tables:
        if t not in _paths:
            continue
        at, fs = _hadoop(t.sparkSession, _paths.pop(t))
        fs.delete(at, True)


def small(table: DataFrame, *columns: str, extra: int = 0) -> DataFrame:
    """A stored table, or some columns of it, with a broadcast hint if its rows, at 16 bytes and 8 for each column, are within ``BROADCAST_BYTES``. The columns
    must be numbers; ``extra`` is what texts add to a row at most."""
    narrow = table.select(*columns) if columns else table
    return F.broadcast(narrow) if row_count(table) * (16 + 8 * len(narrow.columns) + extra) <= BROADCAST_BYTES else narrow


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` with a number that tells its rows apart, and that column's name, which no other column has; stored, so that it stays the same in every read."""
    name = "_row"
    while name in df.columns:
        name += "_"
    return stored(df.withColumn(name, F.monotonically_increasing_id()), label), name


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeezed(c):
    """Text without any ASCII blank; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), BLANKS, "")
