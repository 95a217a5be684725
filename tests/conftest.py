from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def normal(v):
    import decimal
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Whether a query and its SQL give the same rows."""

    def check(query, sql):
        df = query(spark, sf)
        columns = sorted(df.columns)
        mine = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=str)
        found = duck.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        other = sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
        assert mine == other

    return check
