"""Every registered query with SQL against DuckDB on the smallest tables, and that all others run."""

import math
from pathlib import Path

import duckdb
import pytest

from corvane.plans import registry

registry.load()
SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SMALL))
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert found
        return
    relation = duck.sql(registry.ORACLES[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())
