"""The operators that SQL can express equal their SQL."""

import duckdb
import pandas as pd
import pytest
from corpusloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    got, expected = (x[columns].sort_values("doc_id" if "doc_id" in columns else "vec_id").reset_index(drop=True) for x in (got, expected))
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, check_exact=True)
