"""Rows of hot keys are dealt by more than their key."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.tables import looked_up


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_keys_are_salted(spark, no_broadcasts):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("a"), F.col("id").alias("k"))
    found = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"))
    out = looked_up(rows, found.where("a <> 11"), ["a"], "least", "k", 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[a#\d+L?, _salt#\d+L\]", plan) and re.search(r"hashpartitioning\(a#\d+L?, _salt#\d+L", plan)
    least = {r["a"]: r["least"] for r in found.collect()} | {11: None}
    got = out.collect()
    assert len(got) == 3000 and all(r["least"] == least[r["a"]] for r in got)
