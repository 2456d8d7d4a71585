"""Every query with SQL against DuckDB on the small driver tables."""

import math
import os

import duckdb
import pytest

from skyloom.plans import registry
from skyloom.plans import coverage, fields, label, learning, model  # noqa: F401  (they register their queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, bool) or x is None or isinstance(x, (str, int)):
        return x
    return float(x) if type(x).__name__ == "Decimal" else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    # floats last and rough, so that a last digit does not move a row
    key = lambda r: repr([x for x in r if not isinstance(x, float)]) + repr([f"{x:.6g}" for x in r if isinstance(x, float)])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=key)


def close(a, b):
    """Equal, or floats that differ in what a sum's order changes: a last digit far behind the driver's comparison."""
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-7))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in registry.ORACLES:
        res = duck.execute(registry.ORACLES[name])
        names = [c[0] for c in res.description]
        assert sorted(names) == sorted(df.columns)
        want = rows(names, res.fetchall())
        assert len(got) == len(want)
        assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
    else:
        assert df.columns
