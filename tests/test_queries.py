"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from codeloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in (r[i] for i in at)) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    if name not in catalogue.SQL:
        assert df.columns
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalogue.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert rows(got, df.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 12
