"""Every bar query against its SQL on the smallest tables."""

from __future__ import annotations

from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans.oracles import SQL
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def plain(x):
        if pd.isna(x):
            return None
        if isinstance(x, bool | np.bool_):
            return str(x)
        return repr(float(x)) if isinstance(x, Number) else str(x)

    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)
