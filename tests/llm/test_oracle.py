"""The registered SQL against the queries, over whole tables."""

import duckdb
import pandas as pd
import pytest

from gridloom.llm.oracle import oracle_sql
from gridloom.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want, got = con.execute(oracle_sql()[name]).df(), queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    key = got.columns[0]
    both = [x[list(got.columns)].sort_values(key).reset_index(drop=True) for x in (got, want)]
    pd.testing.assert_frame_equal(*both, check_dtype=False)
