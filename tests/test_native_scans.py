"""Scans in Catalyst expressions against plain statements of the same in Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions.listvalues import list_value, list_values
from tessera.operators import ci_thresholds as C

PARTS = ["omit", "exclude", "exclude_lines", " = ", ": ", "[", "]", "[[", "\n", "\r\n", "\n  ", '"a/b"', "'c d'", '""', "x.py", ",", "é", '"[', "tests/*", "\x0c", "omit=[", "'omit': ", "\n]", " "]
KEYS = ("omit", "exclude", "exclude_lines")


def test_lists(spark):
    r = random.Random(6)
    texts = ["".join(r.choices(PARTS, k=r.randrange(30))) for _ in range(1500)] + [None, "", "omit = [" + "a\n" * 3000 + "]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {x["i"]: x["v"] for x in rows.select("i", list_values(F.col("t"), KEYS).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else {k: list_value(t, k) for k in KEYS}), repr(t)
    plan = rows.select(list_values(F.col("t"), KEYS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_retries_near_runners(spark):
    r = random.Random(7)
    rows, lines, expected = [], [], set()
    for cs in range(120):
        text = [r.choice(["x", "x", "x", "x", "uses: nick-fields/retry@v3", "run: pytest -q"]) if r.random() < 0.2 else "x" for _ in range(r.randrange(1, 80))]
        rows.append((cs, 0, ".github/workflows/a.yml", False, "\n".join(text)))
        for n, t in enumerate(text, 1):
            if "retry" in t:
                lines.append((cs, 0, ".github/workflows/a.yml", "head", n, n, t))
                if any("pytest" in x for x in text[max(0, n - 1 - C.BEFORE) : n + C.AFTER]):
                    expected.add((cs, n))
    files = spark.createDataFrame(rows, "cs_id long, file_ord int, path string, is_binary boolean, head_content string")
    changed = spark.createDataFrame(lines, "cs_id long, file_ord int, path string, side string, line_ord int, line_no int, text string")
    found = C.retry_wrapped(changed, files)
    assert sorted((x["cs_id"], x["evidence"][0]["line"]) for x in found.collect()) == sorted(expected) and expected
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
