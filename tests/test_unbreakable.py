"""Hostile numbers, repeated diffs, counts of equal assertions, what is kept and given back."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import rules as R
from tessera.plans.gate import gate
from tessera.schemas import CHANGESETS, FILE_CHANGES
from tessera.sources.pairs import from_pairs
from tessera.streaming.diffs import parsed, read_diff_stream, score_stream


def plain(x: float) -> str:
    return "inf" if x == float("inf") else str(int(x)) if x == int(x) else str(x)


def test_number_texts(spark):
    values = [0.0, 1.0, 80.5, 0.1, 0.0001, 0.00001, 1.5e-7, 123456789.25, 2.0**53, 2.0**53 + 2, 9.3e18, 1e22, 1e25, 9.999e30, 1e38, 1.7e308, float("9" * 31), float("inf"), 4503599627370497.5]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", R.number_text(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [plain(v) for v in values]


@pytest.mark.parametrize("digits", ["9" * 31, "1" + "0" * 26, "9" * 400])
def test_a_hostile_number_hurts_no_other_change(spark, digits):
    rows = [(1, "ci.yml", f"timeout-minutes: {digits}"), (2, "ci.yml", "timeout-minutes: 30")]
    files = from_pairs(spark.createDataFrame([(c, 0, f".github/workflows/{p}", "modified", None, "timeout-minutes: 10\n", t + "\n", False) for c, p, t in rows], "cs_id long, file_ord int, path string, kind string, base_path string, base_content string, head_content string, is_binary boolean"))
    sets = spark.createDataFrame([(c, "b", "h", [], None) for c, _, _ in rows], CHANGESETS)
    done = gate(sets, files)
    assert {r["cs_id"]: r["detail"].split(" to ")[1].split(" in ")[0] for r in done.findings.collect()} == {1: plain(float(digits)), 2: "30"}
    done.release()


DIFF = "diff --git a/.github/workflows/ci.yml b/.github/workflows/ci.yml\n--- a/.github/workflows/ci.yml\n+++ b/.github/workflows/ci.yml\n@@ -1,1 +1,1 @@\n-timeout-minutes: 10\n+timeout-minutes: {}\n"


def test_equal_diffs_are_one_change_set(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a", 40), ("b", 40), ("c", 11)):
        (tmp_path / "in" / f"{name}.diff").write_text(DIFF.format(n))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    score_stream(read_diff_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [80, 100]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
    sets, files = parsed(spark.createDataFrame([(5, DIFF.format(40))] * 3, "cs_id long, raw string"))
    assert (sets.count(), files.count()) == (1, 1)


def test_one_of_two_equal_assertions_removed(spark):
    test = "def test_a():\n    assert x == 1\n{}"
    row = (1, 0, "tests/test_a.py", "modified", None, test.format("    assert x == 1\n"), test.format(""), False)
    files = from_pairs(spark.createDataFrame([row], "cs_id long, file_ord int, path string, kind string, base_path string, base_content string, head_content string, is_binary boolean"))
    done = gate(spark.createDataFrame([(1, "b", "h", [], None)], CHANGESETS), files, rules=("VID002",))
    assert [r["title"] for r in done.findings.collect()] == ["Assertion removed"]


def test_sources_are_parsed_once_for_all_rules(spark):
    row = (1, 0, "tests/test_a.py", "modified", None, "def test_a():\n    assert x == 1\n", "def test_a():\n    assert x\n", False)
    files = spark.createDataFrame([(*row, None)], FILE_CHANGES)
    ids = ("VID001", "VID002", "VID003", "VID004", "VID005", "VID011", "VID012")
    done = gate(spark.createDataFrame([(1, "b", "h", [], None)], CHANGESETS), files, rules=ids)
    assert [r["rule_id"] for r in done.findings.collect()] == ["VID005"]

    def names(plan):
        yield plan.nodeName()
        for i in range(plan.children().size()):
            yield from names(plan.children().apply(i))

    found = list(names(done.scores._jdf.queryExecution().withCachedData()))
    assert "InMemoryRelation" in found and not any("MapInPandas" in n for n in found)
    done.release()
