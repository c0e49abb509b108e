from __future__ import annotations

import os
import tempfile
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
os.environ["PYTHONPATH"] = f"{REPO}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]"))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    """A value that compares alike from both engines."""
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(v)


def same_rows(df, relation) -> None:
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    at = [list(relation.columns).index(c) for c in cols]
    ours = sorted([plain(r[c]) for c in cols] for r in df.collect())
    theirs = sorted([plain(r[i]) for i in at] for r in relation.fetchall())
    assert ours == theirs
