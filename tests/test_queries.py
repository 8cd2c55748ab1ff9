"""Every registered query against its SQL, on the smallest test tables."""

import math
import os
from datetime import datetime
from pathlib import Path

import pytest

from strandmill import file_queries, problems, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
duckdb = pytest.importorskip("duckdb")
QUERIES, SQL = queries.QUERIES | file_queries.QUERIES | problems.QUERIES, queries.SQL | file_queries.SQL | problems.SQL


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v + 0.0:.8g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cur = db.execute(SQL[name])
        assert got == table([d[0] for d in cur.description], cur.fetchall())


def test_flagship_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
