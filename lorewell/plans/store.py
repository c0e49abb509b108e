"""Results that a job reads more than once, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, local mode gets a temporary one, which goes when the driver ends, and a cluster an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lorewell-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet. It is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/lorewell-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """(``df``, computed now and kept as a table, its rows, counted while they were written)."""
    path, seen = f"{new_folder(df.sparkSession)}/rows", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def once(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept, so that what reads it several times doesn't compute it again."""
    return counted(df)[0]
