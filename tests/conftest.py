import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    out = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query gives the rows of its SQL."""

    def plain(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        try:
            return repr(round(float(v), 9))
        except (TypeError, ValueError):
            return str(v)

    def check(query, sql):
        got, want = query(spark, SF).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False))
        assert rows(got) == rows(want)

    return check
