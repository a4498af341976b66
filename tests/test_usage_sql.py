"""Every registered usage query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from meterlake.plans.all_queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("lineitem", "part", "supplier", "events"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def text(name: str, v) -> str:
    if pd.isna(v):
        return ""
    if name.endswith(("day", "month", "start", "seen", "week")) and not isinstance(v, (int, str)):
        return str(pd.Timestamp(v).date())
    return f"{v:.3f}" if isinstance(v, float) else str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    numbers = {c: df[c].map(lambda v: "" if pd.isna(v) else f"{float(v):.3f}") if pd.api.types.is_numeric_dtype(df[c]) and df[c].dtype != bool else df[c].map(lambda v, c=c: text(c, v)) for c in df.columns}
    return sorted(zip(*numbers.values(), strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, db, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(ORACLE_SQL[name]).df())
