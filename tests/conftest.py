import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """A DuckDB connection over the smallest tables."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="session")
def same_rows():
    """Compare a DataFrame with a DuckDB result: column names and rows, in any order."""

    def compare(df, con, sql):
        names = sorted(df.columns)
        cursor = con.execute(sql)
        there = [c[0] for c in cursor.description]
        assert names == sorted(there)
        key = lambda row: tuple((v is None, str(v)) for v in row)
        mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
        other = sorted((tuple(plain(dict(zip(there, r, strict=True))[c]) for c in names) for r in cursor.fetchall()), key=key)
        assert mine == other

    return compare
