"""Every log query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tallylog.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables():
    from tests.conftest import SF_DIR

    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, sf_dir, name):
    mine = QUERIES[name](spark, sf_dir).toPandas()
    theirs = tables.sql(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    mine, theirs = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, theirs))
    assert len(mine) == len(theirs) > 0
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False)
