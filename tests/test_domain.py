"""Every domain query against its SQL in DuckDB, on the smallest tables."""
import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

from cantata import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _rows(df, cols):
    one = lambda x: None if pd.isna(x) else round(float(x), 5) if isinstance(x, (float, int)) or hasattr(x, "as_tuple") else str(x)
    return sorted(map(repr, (tuple(one(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert _rows(got, cols) == _rows(want, cols)
