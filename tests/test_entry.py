from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 30 and all(callable(q) for q in queries.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
