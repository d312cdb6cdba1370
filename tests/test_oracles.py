"""Every query with SQL gives the rows of DuckDB over the smallest tables; every other one runs."""

from pathlib import Path

import duckdb
import pytest
from compare import plain

from larder.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() > 0
