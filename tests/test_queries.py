"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from maploom.plans import registry
from maploom.plans.views import TABLES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list) else repr(v) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in registry.ORACLES:
        return
    result = duck.execute(registry.ORACLES[name])
    named = [d[0] for d in result.description]
    assert sorted(named) == columns
    assert rows == sorted(str([plain(r[named.index(c)]) for c in columns]) for r in result.fetchall())
