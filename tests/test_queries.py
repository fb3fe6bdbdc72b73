"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewheel.plans.relational import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if v == v else None
    if hasattr(v, "is_finite"):
        return round(float(v), 5)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    key = lambda row: tuple((x is None, str(type(x)), str(x)) for x in row)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=key)
    theirs = sorted((tuple(plain(dict(zip(names, r))[c]) for c in order) for r in want.fetchall()), key=key)
    assert len(ours) == len(theirs)
    for mine, other in zip(ours, theirs):
        for x, y in zip(mine, other):
            assert x == y or x == pytest.approx(y, abs=2e-5)


def test_queries_without_sql_have_rows(spark):
    for name in ("episode_kernels", "pelt_segments", "tokenizer_compare"):
        assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
