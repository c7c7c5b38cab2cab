"""A local session, the driver's tables, and DuckDB beside it."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["TIDEMARK_SHARED"] = str(tmp_path_factory.mktemp("shared"))
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str([_plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="session")
def same_rows():
    """Compares a DataFrame's rows, in any order, with those of DuckDB's SQL over the same tables."""

    def compare(df, sql: str, sf_dir: str = DATA) -> None:
        con = duckdb.connect()
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(_plain(x) for x in row) for row in found.fetchall())
        assert sorted(tuple(_plain(row[c]) for c in names) for row in df.collect()) == want

    return compare


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
