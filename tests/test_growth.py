"""What a larger input needs: even tasks before dear work, sources parsed once, no broadcast of what grows."""

from __future__ import annotations

import os
import re

import pytest

from tessera.operators import pairing
from tessera.operators.surfaces import extract_sources
from tessera.plans import derived
from tessera.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plan(df) -> str:
    """The plan before anything ran, without the final one that a run leaves."""
    return df._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["vid001_test_removed", "vid002_assertion_removed", "vid003_test_skipped", "vid004_tolerance_loosened", "vid006_literal_edited", "vid007_unit_mocked", "vid008_exception_swallowed", "vid011_untested_code", "vid009_retry_window", "class_surfaces", "trust_score"])
def test_what_grows_is_not_broadcast(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


@tables
@pytest.mark.parametrize("name", ["vid001_test_removed", "vid006_literal_edited", "vid007_unit_mocked", "vid008_exception_swallowed", "class_surfaces"])
def test_a_source_is_parsed_once(spark, name):
    parsed = [x for x in plan(QUERIES[name](spark, SF)).splitlines() if re.search(r"MapIn(Arrow|Pandas)", x) and "tests#" in x]
    assert len(parsed) == 1


@tables
@pytest.mark.parametrize("name", ["extract_surface", "captures", "class_surfaces", "vid010_list_changes", "vid010_tool_lists", "tokens", "vid006_literal_edited", "vid009_retry_window", "gate_over_orders", "pair_tests"])
def test_one_row_group_is_dealt_to_many_tasks(spark, name):
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF))


@tables
def test_a_customer_is_dealt_by_key(spark):
    assert derived.source_texts(spark.read.parquet(f"{SF}/customer.parquet")).rdd.getNumPartitions() >= 16


def test_repeated_ids_of_both_sides(spark):
    """Of a repeated id the last test counts, at the first one's place, on each side by itself."""
    base, head = "def test_a():\n    assert x == 1\n\n\ndef test_b():\n    pass\n\n\ndef test_a():\n    assert x\n", "def test_c():\n    assert y\n\n\ndef test_a():\n    assert x\n    assert x\n"
    rows = spark.createDataFrame([(1, 0, "test_m.py", "base", base), (1, 0, "test_m.py", "head", head)], "cs_id long, file_ord int, path string, side string, content string")
    got = pairing.pair_tests(pairing.test_rows(extract_sources(rows))).orderBy("pair_ord").collect()
    assert [(r["test_id"].split("::")[1], r["base_test_ord"], r["base_n_assertions"], r["head_test_ord"], r["head_n_assertions"], r["removed"], r["added"], r["strength_delta"]) for r in got] == [
        ("test_a", 0, 1, 1, 2, False, False, 30), ("test_b", 1, 0, None, None, True, False, 0), ("test_c", None, None, 0, 1, False, True, 30),
    ]
