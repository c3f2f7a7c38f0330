"""Every query with SQL returns what DuckDB returns."""

import duckdb
import pandas as pd
import pytest

from hardwood.plans.registry import QUERIES, SQL
from tests.conftest import SF


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "labels", "conversations", "part", "supplier", "embeddings", "pages", "customer", "nation", "region"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
