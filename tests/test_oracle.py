"""Every library query against its SQL in DuckDB, on the smallest tables."""

import os

import pandas as pd
import pytest

from brindle.registry import all_entries

FOLDER = "/root/testdata/sf0.001"
ENTRIES = all_entries()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(name, spark, duck):
    query, sql = ENTRIES[name]
    got = query(spark, FOLDER).toPandas()
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert set(got.columns) == set(want.columns)
    got, want = ordered(got), ordered(want)
    assert len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head(3).tolist(), want[c][~same].head(3).tolist())
