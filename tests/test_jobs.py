"""The jobs over growing input, reruns, hostile rows and their command line."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import change_intake, gate_audit
from jobs.settings import default_file, read_config

ROOT = Path(__file__).resolve().parents[1]
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def held(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_configuration(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"files_per_batch": 3}')
    assert read_config(str(file), change_intake.KNOWN) == {"files_per_batch": 3, "ignore_globs": []} and read_config(None, change_intake.KNOWN) == change_intake.KNOWN
    for bad in ('{"files": 3}', '{"files_per_batch": "3"}', '{"files_per_batch": true}'):
        file.write_text(bad)
        with pytest.raises(ValueError):
            read_config(str(file), change_intake.KNOWN)
    for job in (gate_audit, change_intake):
        assert set(read_config(default_file(job.__file__), job.KNOWN)) == set(job.KNOWN)


@needs_tables
def test_months_are_replaced_one_by_one(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("year(o_orderdate) = 1995 and month(o_orderdate) <= 3")
    before, more, out = (str(tmp_path / x) for x in ("orders", "more", "audit"))
    orders.where("o_orderkey % 2 = 0").write.parquet(before)
    orders.write.parquet(more)
    config = read_config(default_file(gate_audit.__file__), gate_audit.KNOWN) | {"rules": ["VID009"]}
    persisted = spark.sparkContext._jsc.getPersistentRDDs().size()
    first = held(gate_audit.run(spark, before, out, config))
    assert len(first) == orders.where("o_orderkey % 2 = 0").count()
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static" and spark.sparkContext._jsc.getPersistentRDDs().size() <= persisted
    # The table has grown: one month is audited again, twice, the others keep what they had.
    for _ in range(2):
        again = gate_audit.run(spark, more, out, {**config, "months": ["1995-02"]})
        rows = {m: again.where(f"month = '{m}'").count() for m in ("1995-01", "1995-02", "1995-03")}
        assert rows == {m: orders.where(f"date_format(o_orderdate, 'yyyy-MM') = '{m}' and ({m == '1995-02'} or o_orderkey % 2 = 0)").count() for m in rows}
    assert held(again.where("month <> '1995-02'")) == [r for r in first if "month='1995-02'" not in r]
    with pytest.raises(ValueError, match="yyyy-mm"):
        gate_audit.run(spark, more, out, {**config, "months": ["1995-2"]})


def test_a_month_reaches_the_scan(spark, tmp_path):
    spark.sql("select timestamp_ntz'1995-12-31 23:59:59' as o_orderdate union all select timestamp_ntz'1996-01-01'").write.parquet(str(tmp_path / "o"))
    rows = spark.read.parquet(str(tmp_path / "o"))
    kept = rows.where(gate_audit._in_months(rows["o_orderdate"], ["1995-12"]))
    assert [str(r[0]) for r in kept.collect()] == ["1995-12-31 23:59:59"] and "GreaterThanOrEqual(o_orderdate" in kept._jdf.queryExecution().executedPlan().toString()


ODD = [(0, None, "en", "s", 0), (6, "", "en", "s", 0), (12, "one\r\ntwo\x0bthree\n\n +four\n-five\n@@ -1 +1 @@\ndiff --git a/x b/x\n", None, None, 9), (5, "\\ No newline\nlast", "de", "src2", 3), (7, "\t\n" * 5000 + "x" * 100_000, "en", "src2", 1), (7, "a\nb", "en", "src2", 1)]


def plain(doc_id, text):
    """(removed, added, first removed) of a document, by its lines."""
    lines = (text or "").splitlines()
    gone = [i for i in range(1, len(lines) + 1) if (doc_id + i) % 7 == 0]
    return len(gone), sum((doc_id + i) % 11 == 0 and (doc_id + i) % 7 != 0 for i in range(1, len(lines) + 1)), gone[0] if gone else None


def test_only_new_documents_are_taken(spark, tmp_path):
    arriving, out, checkpoint = (str(tmp_path / x) for x in ("in", "ledger", "checkpoint"))
    config = {**change_intake.KNOWN, "files_per_batch": 1}
    first, second = [(i, f"line {i}\n" * (i % 30), "en", f"src{i % 3}", i) for i in range(60)], [*ODD, *[(100 + i, "x\n" * i, "fr", "src1", i) for i in range(20)]]

    def expected(rows):
        return sorted((i, *plain(i, t)) for i, t, *_ in rows)

    def read(df):
        assert df.where("parse_error is not null").count() == 0
        return sorted((r["cs_id"], r["n_removed"], r["n_added"], r["first_removed"]) for r in df.collect())

    spark.createDataFrame(first, DOCS).repartition(3).write.parquet(arriving)
    assert read(change_intake.run(spark, arriving, out, checkpoint, config)) == expected(first)
    assert read(change_intake.run(spark, arriving, out, checkpoint, config)) == expected(first)  # nothing new
    old = {p: p.stat().st_mtime_ns for p in Path(out).rglob("part-*")}
    spark.createDataFrame([(*r, "extra") for r in second], f"{DOCS}, path string").write.mode("append").parquet(arriving)
    # A file older than any that was read counts as well.
    late = [(900, "a\nb\nc", "en", "src0", 1)]
    spark.createDataFrame(late, DOCS).coalesce(1).write.mode("append").parquet(arriving)
    newest = max(Path(arriving).glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
    os.utime(newest, (1, 1))
    got = change_intake.run(spark, arriving, out, checkpoint, config)
    assert read(got) == expected([*first, *second, *late])
    assert all(p.stat().st_mtime_ns == t for p, t in old.items())
    assert {r["language"] for r in got.select("language").distinct().collect()} <= {"python", "typescript", "javascript", "none", "tsx"}
    assert not spark.streams.active


def test_an_unreadable_diff_is_a_row(spark):
    rows = change_intake.ledger(spark.createDataFrame([(1, "no diff"), (2, "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-x\n+y\n")], "cs_id long, raw string"), change_intake.GateConfig()).collect()
    assert [(r["cs_id"], r["path"], r["n_removed"], r["parse_error"] is None, r["language"]) for r in rows] == [(1, None, 0, False, "none"), (2, "a.py", 1, True, "python")]


@needs_tables
def test_command_line(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"files_per_batch": 2}))
    done = subprocess.run(
        [sys.executable, "-m", "jobs.change_intake", "--documents", f"{SF}/documents.parque[t]", "--output", str(tmp_path / "o"), "--checkpoint", str(tmp_path / "k"), "--config", str(tmp_path / "c.json")],
        cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 documents in 1 batches" in done.stderr and list((tmp_path / "o").glob("language=*/part-*"))


@needs_tables
@pytest.mark.parametrize("name", ["job1_gate_audit", "job2_change_intake"])
def test_query_against_sql(spark, name):
    from jobs.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("orders", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, expected = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(str, got.select(*columns).toArrow().to_pylist())) == sorted(map(str, expected.select(*columns).to_arrow_table().to_pylist()))
