"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from tessera.oracles import ORACLES
from tessera.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(pdf: pd.DataFrame) -> tuple:
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple("NULL" if pd.isna(v) else format(v, ".9g") if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF)
    assert all(not t.startswith(("array", "map", "struct")) for _, t in got.dtypes)
    if name in ORACLES:
        assert rows(got.toPandas()) == rows(sql.sql(ORACLES[name]).df())
    else:
        assert got.count() > 0
