"""The running score of repositories over three runs, with repeats, bad diffs and a batch that is run again."""

from __future__ import annotations

import json
import shutil

from tessera.streaming.repositories import latest_totals, read_arrivals, running_scores

DIFF = "diff --git a/.github/workflows/ci.yml b/.github/workflows/ci.yml\n--- a/.github/workflows/ci.yml\n+++ b/.github/workflows/ci.yml\n@@ -1,1 +1,1 @@\n-timeout-minutes: 10\n+timeout-minutes: {}\n"


def test_three_runs(spark, tmp_path):
    arriving, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    persisted = spark.sparkContext._jsc.getPersistentRDDs().size()

    def send(name, *rows):
        (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps({"repository": r, "arrived": f"2025-01-{day:02}T00:00:00", "raw": raw}) + "\n" for r, day, raw in rows))

    def run():
        running_scores(read_arrivals(spark, arriving), out, checkpoint, delay="2 days").awaitTermination()
        return {r["repository"]: (r["n_scored"], r["n_failed"], r["sum_value"], r["least_value"]) for r in latest_totals(spark, out).collect()}

    send("a", ("r1", 1, DIFF.format(40)), ("r1", 1, DIFF.format(11)), ("r2", 1, DIFF.format(40)), ("r1", 1, DIFF.format(40)), ("r2", 1, "no diff"), ("r3", 1, None))
    assert run() == {"r1": (2, 0, 180, 80), "r2": (1, 0, 80, 80)}
    # One diff comes again, one is new to the repository.
    send("b", ("r1", 2, DIFF.format(40)), ("r2", 2, DIFF.format(11)))
    assert run() == {"r1": (2, 0, 180, 80), "r2": (2, 0, 180, 80)}
    # The last batch is run again, as after a failure before it was committed.
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "checkpoint" / "commits").iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    shutil.rmtree(tmp_path / "out" / "totals" / f"batch={last}")
    assert run() == {"r1": (2, 0, 180, 80), "r2": (2, 0, 180, 80)}
    send("c", ("r3", 3, DIFF.format(30)), ("r1", 3, DIFF.format(11)))
    assert run() == {"r1": (2, 0, 180, 80), "r2": (2, 0, 180, 80), "r3": (1, 0, 80, 80)}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= persisted and not spark.streams.active
