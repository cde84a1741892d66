"""Each registered query of the relational part against its DuckDB text."""

import os

import duckdb
import pytest

from siltstone.plans.catalog import ORACLES, QUERIES
from siltstone.plans.views import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    if name not in ORACLES:  # held against numpy in test_jobs
        row = dict(zip(columns, got[0], strict=True))
        assert name == "eval_bootstrap_ci" and len(got) == 1 and row["ci_lo"] < row["ci_hi"]
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(row[names.index(c)] for c in columns) for row in found.fetchall()), key=repr)
    assert [repr(r) for r in got] == [repr(r) for r in expected]
