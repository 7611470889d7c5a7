"""Every catalogue query against its SQL twin in DuckDB."""

import os

import duckdb
import pytest

from weirflow.plans import catalogue, catalogue_ops  # noqa: F401

TOP = os.environ.get("WEIRFLOW_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TOP}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, TOP)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(catalogue.SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want
