"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from bytecairn.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if isinstance(v, float) and not pd.isna(v):
            return f"{v:.3f}"
        return "null" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and pd.isna(v)) else str(v)

    columns = sorted(frame.columns)
    return sorted(zip(*[[value(v) for v in frame[c].astype(object)] for c in columns]))


def numbers(rows):
    """Whole numbers alike whether a null made them floats or not."""
    return [tuple(c[:-4] if c.endswith(".000") else c for c in r) for r in rows]


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, data, name):
    got, want = catalogue.queries()[name](spark, data).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert numbers(canonical(got)) == numbers(canonical(want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
