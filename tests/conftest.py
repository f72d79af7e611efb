import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


def rows_of(values):
    return sorted(repr(tuple(None if v != v else v for v in r)) for r in values)


@pytest.fixture(scope="session")
def same(spark):
    """Holds a query against its SQL on the smallest tables."""
    import glob

    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def check(query, sql):
        got, want = query(spark, d), con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert rows_of(map(tuple, got.select(cols).collect())) == rows_of(want.select(*[f'"{c}"' for c in cols]).fetchall())

    return check
