"""Every query of the catalogue against its SQL over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from millrace.plans import catalog

SQL = catalog.oracle_sql()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(small_tables):
    con = duckdb.connect()
    for p in glob.glob(f"{small_tables}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, small_tables, name):
    df = catalog.queries()[name](spark, small_tables)
    names = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    found = duck.execute(SQL[name])
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert got == sorted(tuple(norm(x[i]) for i in at) for x in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, small_tables, name):
    assert catalog.queries()[name](spark, small_tables).count() >= 0
