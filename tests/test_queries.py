"""Every query of the engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from millrace import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in core.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_same_as_duckdb(spark, duck, name):
    df = core.queries()[name](spark, SF)
    want = duck.execute(core.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    assert sorted(df.columns) == sorted(cols)
    norm = lambda v: None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    theirs = sorted(repr([norm(r[i]) for i in order]) for r in want.fetchall())
    mine = sorted(repr([norm(r[c]) for c in sorted(cols)]) for r in df.collect())
    assert mine == theirs
