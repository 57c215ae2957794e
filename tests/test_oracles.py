"""Every query with SQL gives the rows of that SQL, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables")

from rasterloom.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _key(columns, rows):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(plain(r[i]) for i in by) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = _key(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _key(columns, cur.fetchall())
    assert got or name == "q_length_moments"  # no pair of nations trades often enough in the smallest tables


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_other_queries_run(spark, name):
    df = entry.queries()[name](spark, DIR)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
