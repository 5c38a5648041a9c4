"""Every query with SQL gives what the SQL gives, over the smallest tables."""

from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    return sorted([tuple(plain(v) for v in r) for r in frame.itertuples(index=False)], key=repr)


def plain(v):
    """A value that is the same from both sides: truth values of Python and numpy alike, numbers as floats, the rest as text."""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return None if pd.isna(v) else float(v) if isinstance(v, Number) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, sql, name):
    got, wanted = catalogue.QUERIES[name](spark, SF).toPandas(), sql.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
