"""One session for all tests, and a DuckDB comparison."""

from __future__ import annotations

import decimal
import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str)


def oracle_rows(sql, data=DATA):
    import duckdb

    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    columns = sorted(c.sql(sql).columns)
    found = c.sql("select " + ",".join(f'"{x}"' for x in columns) + f" from ({sql}) q").fetchall()
    return columns, sorted((tuple(plain(x) for x in r) for r in found), key=str)
