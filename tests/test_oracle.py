"""Every registered query with an oracle matches DuckDB on the sf0.001 tables
(row count, column names, order-insensitive values); queries without one run
and return rows."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from paths import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()
TABLES = ["customer", "orders", "lineitem", "part", "events", "nation", "region", "supplier",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, bool):
        return int(v)
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    hs = sorted(hashlib.md5(repr(tuple(_norm(r[i]) for i in order)).encode()).hexdigest()
                for r in rows)
    return hashlib.md5("".join(hs).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert _digest(df.columns, rows) == _digest(dcols, drows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 1


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "churn_rate_pct" in df.columns
