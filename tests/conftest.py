"""One session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    """A value that compares alike from both engines."""
    if isinstance(v, float):
        return "null" if v != v else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return "null" if v is None else str(v)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """same(query, sql): equal columns and rows, in any order."""

    def check(query, sql: str) -> int:
        df = query(spark, str(DATA))
        cols = sorted(df.columns)
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
        theirs = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
        assert mine == theirs
        return len(mine)

    return check
