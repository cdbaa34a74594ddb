"""Every core query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from corpusloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1).map(lambda x: round(x, 6) if isinstance(x, float) else x)
    df = df.astype(str).replace({"None": "nan", "<NA>": "nan"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, expected = ordered(QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(SQL[name]).df())
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)
