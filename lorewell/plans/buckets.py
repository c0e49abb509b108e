"""Tables that change in place: Parquet in hash buckets of one column, of which a change reads and writes only those that it touches.

Each write makes a new folder; a small file of the table says which folders hold each bucket and comes last, by a rename. Readers go by the newest such file, so
a write that stops leaves the table as it was, and of two writers at once the second fails and can be repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.history import clear_sessions, upsert_messages
from ..schemas import CHUNKS, MESSAGES

BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketTable:
    path: str
    schema: str
    key: str
    buckets: int = 64

    def number(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")


def messages_table(path: str, buckets: int = 64) -> BucketTable:
    return BucketTable(path, MESSAGES, "session_id", buckets)


def chunks_table(path: str, buckets: int = 64) -> BucketTable:
    return BucketTable(path, CHUNKS, "chunk_id", buckets)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, table: BucketTable) -> tuple[int, dict[int, list[str]]]:
    """(version, folders of each bucket that has rows); version 0 is the empty table."""
    at, fs = _hadoop(spark, f"{table.path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    version = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
    if not version:
        return 0, {}
    (row,) = spark.read.text(f"{table.path}/versions/{version:08d}.json", wholetext=True).collect()  # as many entries as buckets
    return version, {int(k): v for k, v in json.loads(row["value"]).items()}


def commit(spark: SparkSession, table: BucketTable, version: int, held: dict[int, list[str]]) -> None:
    """Make ``held`` the table, if it is still at the version before."""
    temporary, fs = _hadoop(spark, f"{table.path}/versions/_{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(json.dumps(held).encode())
    out.close()
    final, _ = _hadoop(spark, f"{table.path}/versions/{version:08d}.json")
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise RuntimeError(f"{table.path} was changed by another writer")


def read_buckets(spark: SparkSession, table: BucketTable, some: list[int] | None = None) -> DataFrame:
    """The table, or some of its buckets."""
    _, held = folders(spark, table)
    paths = [f"{table.path}/{f}" for b, own in held.items() if some is None or b in some for f in own]
    return spark.read.schema(table.schema).parquet(*paths) if paths else spark.createDataFrame([], table.schema)


def touched(table: BucketTable, changes: DataFrame) -> list[int]:
    return sorted(r[0] for r in changes.select(table.number()).distinct().collect())  # as many as buckets, at most


def _write(rows: DataFrame, table: BucketTable) -> dict[int, str]:
    """New folders with the rows, by bucket."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.withColumn(BUCKET, table.number()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{table.path}/{name}")
    at, fs = _hadoop(spark, f"{table.path}/{name}")
    made = [f.getPath().getName() for f in fs.listStatus(at)]
    return {int(n.split("=")[1]): f"{name}/{n}" for n in made if n.startswith(f"{BUCKET}=")}


def append(rows: DataFrame, table: BucketTable) -> None:
    """Further rows, in folders beside those that are there."""
    version, held = folders(rows.sparkSession, table)
    made = _write(rows, table)
    commit(rows.sparkSession, table, version + 1, {b: [*held.get(b, []), *([made[b]] if b in made else [])] for b in {*held, *made}})


def append_new(rows: DataFrame, table: BucketTable) -> None:
    """Those rows whose key the table doesn't have. Of the buckets that the rows fall in only the keys are read."""
    there = read_buckets(rows.sparkSession, table, touched(table, rows)).select(table.key)
    append(rows.join(there, table.key, "left_anti"), table)


def change(changes: DataFrame, table: BucketTable, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Put ``merge`` of the old rows and the changes in the place of the buckets that the changes fall in; those buckets are returned. A bucket is taken over
    in one folder again, whatever was appended to it."""
    spark = changes.sparkSession
    version, held = folders(spark, table)
    hit = touched(table, changes)
    made = _write(merge(read_buckets(spark, table, hit), changes), table)
    commit(spark, table, version + 1, {b: own for b, own in held.items() if b not in hit} | {b: [f] for b, f in made.items()})
    return hit


def upsert_stored(changes: DataFrame, table: BucketTable) -> list[int]:
    """``upsert_messages`` on a stored table of messages; an id is known within its session."""
    return change(changes, table, lambda old, new: upsert_messages(old, new.select(old.columns)))


def clear_stored(sessions: DataFrame, table: BucketTable) -> list[int]:
    """Without the messages of these sessions; only their buckets are written anew."""
    return change(sessions.select("session_id"), table, lambda old, gone: clear_sessions(old, gone)[0])
