"""Every ledger query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from docledger.fixtures import TABLES
from docledger.queries import ORACLE, QUERIES

WHERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{WHERE}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, list | tuple | np.ndarray):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | np.integer | np.floating | decimal.Decimal):
        return f"{float(v):.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None))


def test_wallets_by_numbers_in_file_names(spark, tmp_path):
    """Keys of six digits: a file name's number is a seller's, whose wallet a document without a labelled seller gets."""
    con = duckdb.connect()
    for t in TABLES:
        moved = {"orders": "REPLACE (o_orderkey + 120000 AS o_orderkey, o_orderkey + 20000 AS o_custkey)", "customer": "REPLACE (c_custkey + 20000 AS c_custkey)"}.get(t, "")
        con.execute(f"COPY (SELECT * {moved} FROM '{WHERE}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = QUERIES["job_full"](spark, str(tmp_path)).toPandas(), con.execute(ORACLE["job_full"]).df()
    assert rows(got) == rows(want)
    assert (got[got.vendor == "Google Asia Pacific"].wallet != "EWL778").any()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, WHERE).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
