"""Every query with SQL against DuckDB on the smallest test tables."""

import os

import duckdb
import pandas as pd
import pytest

from quire.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (float,)):
            return round(v, 4)
        return v.item() if hasattr(v, "item") and not isinstance(v, pd.Timestamp) else v

    return sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = db.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda rows: [tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows]
    assert sorted(norm(canon(got)), key=repr) == sorted(norm(canon(want)), key=repr)
