"""Every registered query of the engine, against DuckDB where it has an oracle, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from srcloom.plans import catalog

Q, O = catalog.queries(), catalog.oracle_sql()


def norm(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
            return repr(round(float(v), 5))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, tiny, con, name):
    got = Q[name](spark, tiny).toPandas()
    if name in O:
        want = con.sql(O[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert norm(got) == norm(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "id", "score", "matched", "rank"]
