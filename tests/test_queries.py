"""Each manufacturing query that SQL can state against its SQL on the smallest tables; test_models.py has the others."""

import math
from pathlib import Path

import duckdb
import pytest

from kilnworks.plans import registry

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    theirs = sql.sql(registry.ORACLES[name])
    assert sorted(theirs.columns) == columns
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(map(plain, r)) for r in theirs.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)
    assert mine == want
