from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.config import GateConfig, RuleSetting
from tessera.operators import findings as Fi
from tessera.operators import pairing as P
from tessera.operators.surfaces import extract_sources, surfaces
from tessera.plans.gate import CORE, gate
from tessera.schemas import CHANGESETS, FILE_CHANGES, FINDINGS
from tessera.sources.pairs import from_pairs

FILES = "cs_id long, file_ord int, path string, kind string, base_path string, base_content string, head_content string, is_binary boolean"
BASE = "def test_kept():\n    assert a == 1\n    assert b\n\ndef test_gone():\n    assert a is None\n\ndef test_dup():\n    assert 1\n\ndef test_dup():\n    assert a == 2\n"
HEAD = "import pytest\n\ndef test_kept():\n    assert b\n\n@pytest.mark.skip\ndef test_new():\n    assert a == 3\n\ndef test_dup():\n    assert a == 2\n"


def test_states_of_sides(spark):
    rows = [
        (1, 0, "test_a.py", "added", None, None, HEAD, False), (2, 0, "test_a.py", "deleted", None, BASE, None, False), (3, 0, "test_a.py", "modified", None, None, "def (", False),
        (4, 0, "test_a.py", "modified", None, BASE, BASE, True), (5, 0, "src/a.py", "modified", None, BASE, BASE, False), (6, 0, "a.test.ts", "modified", None, "x", "y", False), (7, 0, "test_a.py", "modified", None, "", HEAD, False),
    ]
    out = {(r["cs_id"], r["side"]): (r["status"], r["parse_ok"], None if r["tests"] is None else len(r["tests"])) for r in surfaces(spark.createDataFrame(rows, FILES)).collect()}
    assert out[1, "base"] == ("absent", True, 0) and out[1, "head"] == ("parsed", True, 3) and out[2, "head"] == ("absent", True, 0)
    assert out[3, "base"] == ("unknown", None, None) and out[3, "head"] == ("unparsed", False, None) and out[7, "base"] == ("parsed", True, 0)
    assert {out[i, s] for i in (4, 5, 6) for s in ("base", "head")} == {("not_applicable", None, None)}


@pytest.fixture(scope="module")
def pairs(spark):
    rows = spark.createDataFrame([(1, 0, "t.py", "base", BASE), (1, 0, "t.py", "head", HEAD)], "cs_id long, file_ord int, path string, side string, content string")
    return P.test_rows(extract_sources(rows)).persist()


def test_pairs(pairs):
    got = [(r["test_id"], r["removed"], r["added"], r["strength_delta"]) for r in P.pair_tests(pairs).orderBy("pair_ord").collect()]
    assert got == [("t.py::test_kept", False, False, -100), ("t.py::test_gone", True, False, -20), ("t.py::test_dup", False, False, 0), ("t.py::test_new", False, True, 100)]


def test_totals_keep_repeats_and_skip_the_skipped(pairs):
    got = {r["side"]: (r["n_tests"], r["n_running"], r["n_assertions"], r["strength"]) for r in P.surface_totals(pairs).collect()}
    assert got == {"base": (4, 4, 5, 100 + 30 + 20 + 30 + 100), "head": (3, 2, 3, 130)}


def test_focus_is_no_skip_and_signatures(spark):
    row = spark.sql("select named_struct('skip_markers', array(named_struct('reason', 'exclusive_focus')), 'is_discoverable', true) as t, named_struct('kind', 'call', 'callee', 'f', 'operands', array('a', 'b')) as a")
    assert row.select(P.will_run(F.col("t")).alias("w"), P.signature(F.col("a")).alias("s"), P.strength(F.lit("snapshot")).alias("r"), P.strength(F.lit("none")).alias("n")).first() == (True, "call:f:a|b", 90, None)


def finding(cs, rule, severity, penalty, path="p", line=1, justification=None):
    return (cs, rule, severity, "t", "d", path, penalty, [(path, line, "head", "s")], justification, 0, 0, 0)


def test_order_and_validation(spark):
    rows = spark.createDataFrame([finding(1, "B", "low", 5), finding(1, "B", "high", 5, "f", 10), finding(1, "B", "high", 5, "f", 2), finding(1, "A", "high", 5), finding(1, "Z", "high", 9)], FINDINGS)
    got = [(r["rule_id"], r["severity"], r["evidence"][0]["line"]) for r in Fi.in_order(rows).collect()]
    assert got == [("Z", "high", 1), ("A", "high", 1), ("B", "high", 10), ("B", "high", 2), ("B", "low", 1)]
    for bad in (finding(1, "A", "low", -1), finding(1, "A", "low", 1, line=0)):
        with pytest.raises(Exception, match="non-negative|count from 1"):
            Fi.checked(spark.createDataFrame([bad], FINDINGS)).collect()
    assert spark.range(1).select(Fi.location(F.lit("p"), F.lit(None).cast("array<struct<path:string,line:int>>")).alias("l")).first()["l"] == "p"


def test_scores(spark):
    sets = spark.createDataFrame([(i, "b", "h", [], None) for i in range(1, 6)], CHANGESETS)
    rows = [finding(1, "A", "low", 30), finding(2, "A", "critical", 40, justification="ok"), finding(2, "B", "low", 8), *[finding(3, "A", "high", 50)] * 3, finding(4, "A", "medium", 31)]
    got = {r["cs_id"]: (r["value"], r["passed"], r["band"], r["worst_severity"], r["summary"]) for r in Fi.scores(sets, spark.createDataFrame(rows, FINDINGS), GateConfig()).collect()}
    assert got[1] == (70, True, "acceptable", "low", "Trust 70/100 (acceptable) — 1 unjustified finding") and got[2][:4] == (92, True, "trusted", "low") and got[3][:4] == (0, False, "untrusted", "high")
    assert got[4][:3] == (69, False, "suspect") and got[5] == (100, True, "trusted", None, "Trust 100/100 (trusted) — no verification loss detected")
    strict = {r["cs_id"]: (r["band"], r["passed"]) for r in Fi.scores(sets, spark.createDataFrame(rows, FINDINGS), GateConfig(fail_under=95)).collect()}
    assert strict[2] == ("trusted", False)


def test_trailers(spark):
    said = ["Lower\n\nGate-Justification: vid009 — too slow ", "x\nGate-Justification: VID010 - moved\nOther: VID001 - no", "Gate-Justification: VID009 - later"]
    sets = spark.createDataFrame([(1, "b", "h", said, None)], CHANGESETS)
    config = GateConfig()
    reasons = Fi.justifications(sets, config)
    assert {(r["rule_id"], r["reason"]) for r in reasons.collect()} == {("VID009", "later"), ("VID010", "moved")}
    rows = spark.createDataFrame([finding(1, "VID009", "high", 20), finding(1, "VID011", "low", 5)], FINDINGS)
    assert {r["rule_id"]: r["justification"] for r in Fi.justify(rows, reasons, config).collect()} == {"VID009": "later", "VID011": None}
    assert {r["justification"] for r in Fi.justify(rows, reasons, GateConfig(allow_justification=False)).collect()} == {None}


def test_gate_with_extension_rules(spark):
    files = from_pairs(spark.createDataFrame([(1, 0, "tests/test_a.py", "modified", None, BASE, HEAD, False), (1, 1, "src/a.py", "modified", None, "x\n", "x\ny\n", False), (2, 0, "tests/test_b.py", "modified", None, None, HEAD, False)], FILES))
    sets = spark.createDataFrame([(1, "b", "h", [], None), (2, "b", "h", [], None), (3, None, None, None, "bad diff")], CHANGESETS)
    done = gate(sets, files, rules=(*CORE, "VID001", "VID002", "VID005", "VID011", "VID003"))
    got = sorted((r["cs_id"], r["rule_id"], r["evidence"][0]["snippet"]) for r in done.findings.collect())
    assert got == [(1, "VID001", "tests/test_a.py::test_gone"), (1, "VID002", "tests/test_a.py::test_kept"), (1, "VID011", "y")]
    assert {r["cs_id"]: r["value"] for r in done.scores.collect()} == {1: 50, 2: 100}
    none = gate(sets, files, GateConfig(rules={r: RuleSetting(enabled=False) for r in CORE}))
    assert none.findings.count() == 0 and {r["value"] for r in none.scores.collect()} == {100}
    assert spark.createDataFrame([], FILE_CHANGES).schema == files.schema


def test_stream(spark, tmp_path):
    from tessera.streaming.diffs import read_diff_stream, score_stream

    (tmp_path / "in").mkdir()
    good = "diff --git a/tox.ini b/tox.ini\n--- a/tox.ini\n+++ b/tox.ini\n@@ -1 +1 @@\n-flake8\n+flake8 --exit-zero\n"
    (tmp_path / "in" / "a.diff").write_text(good)
    (tmp_path / "in" / "b.diff").write_text("junk")
    query = score_stream(read_diff_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert query.exception() is None and [r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [80]
