"""The gate reads a change set's files once and gathers its findings once; the audit of odd orders is that of SQL."""

from __future__ import annotations

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs.queries import ORACLES, QUERIES
from tessera.operators import findings as Fi
from tessera.plans import derived
from tessera.plans.gate import gate
from tessera.queries import QUERIES as OWN

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("name, scans", [("findings_sorted", 2), ("justified_findings", 2), ("trust_score", 3), ("gate_over_orders", 3)])
def test_both_rules_read_the_orders_once(spark, name, scans):
    """Once for findings; the change sets are read apart."""
    told = plan(OWN[name](spark, SF))
    assert len(re.findall("FileScan|Scan parquet", told)) <= scans and "InMemoryTableScan" not in told


@tables
def test_an_audit_gathers_findings_once(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    told = plan(gate(derived.order_changesets(orders), derived.gate_corpus(orders)).judged())
    assert len(re.findall("FileScan|Scan parquet", told)) == 2 and told.count("Exchange hashpartitioning") == 2 and told.count("SortMergeJoin") == 1
    assert "Broadcast" not in told and "Window" not in told


@tables
def test_judged_is_what_the_three_say(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    done = gate(derived.order_changesets(orders), derived.gate_corpus(orders))
    both = done.judged().persist()
    scores = sorted(map(str, both.select(*Fi.SCORE).collect()))
    assert scores == sorted(map(str, done.scores.collect()))
    nested = both.select("cs_id", F.explode("findings").alias("f")).select("cs_id", "f.*")
    flat = Fi.placed(done.findings).select("cs_id", "place", "rule_id", "severity", "penalty", "title", "detail", Fi.location(F.col("path"), F.col("evidence")).alias("location"), "justification")
    rows = sorted(map(str, nested.collect()))
    assert rows == sorted(map(str, flat.collect())) and len(rows) > 1000
    both.unpersist()


@tables
def test_odd_orders_against_sql(spark, tmp_path):
    """Orders without a key, a date, a price or a customer, and repeated keys, which are one change set for the rules and a row each in the audit."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 150")
    again = orders.where("o_orderkey % 3 = 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 7))
    odd = [orders.where(f"o_orderkey between {40 * i} and {40 * i + 30}").withColumn(c, F.lit(None).cast(t)) for i, (c, t) in enumerate([("o_orderkey", "long"), ("o_orderdate", "timestamp_ntz"), ("o_totalprice", "double"), ("o_custkey", "long")])]
    odd = [o if i == 0 else o.withColumn("o_orderkey", F.col("o_orderkey") + 1000 * i) for i, o in enumerate(odd)]
    rows = orders.unionByName(again)
    for o in odd:
        rows = rows.unionByName(o)
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got, expected = QUERIES["job1_gate_audit"](spark, str(tmp_path)), con.sql(ORACLES["job1_gate_audit"])
    columns = sorted(got.columns)

    def rows_of(table):
        # Findings of different checks on one line stand in the order of the checks, which SQL doesn't know.
        return sorted(str({**r, "findings": sorted(r["findings"].split("|"))}) for r in table.to_pylist())

    assert rows_of(got.select(*columns).toArrow()) == rows_of(expected.select(*columns).to_arrow_table())
    assert got.where("cs_id is null").count() == 31 and got.where("month is null").count() == 31 and got.count() == rows.count()
