"""The contract queries that SQL can express against DuckDB, over whole tables."""

import pandas as pd
import pytest

from tallylog.llm.queries import ORACLE_SQL, QUERIES
from tests.test_oracle import tables  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, tables, sf_dir, name):  # noqa: F811
    mine, theirs = QUERIES[name](spark, sf_dir).toPandas(), tables.sql(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    mine, theirs = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, theirs))
    assert len(mine) == len(theirs) > 0
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False)
