"""Scores the change sets of whole months and keeps them, with their findings, by month.

A team that gates its changes wants to see afterwards what came in, what was let through and why,
under the configuration of today. The job reads the orders, derives a change set of two
configuration files for each, runs the gate, and writes one row for each change set, its findings
nested in order, below `month=yyyy-MM`.

`months` in the configuration names the months to be audited (none: all). Their filter reaches the
Parquet scan as ranges of dates. Named months are replaced one by one (dynamic partition overwrite),
a month without change sets keeps what it had; a run over all months replaces the whole output.
Either way a rerun over the same orders leaves the same rows. A month is written in
`files_per_month` parts, dealt by change set, so a month of very many rows isn't one task's.
"""

from __future__ import annotations

import logging
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import command_line, default_file
from tessera.config import GateConfig
from tessera.operators.findings import NESTED
from tessera.plans import derived
from tessera.plans.gate import gate

LOG = logging.getLogger("jobs.gate_audit")
KNOWN: dict[str, Any] = {"months": [], "files_per_month": 1, "rules": ["VID009", "VID010"], "gate": {}}
AUDIT = f"cs_id long, value int, threshold int, passed boolean, band string, worst_severity string, n_unjustified long, summary string, findings array<{NESTED}>, month string"
COLUMNS = ("cs_id", "value", "threshold", "passed", "band", "worst_severity", "n_unjustified", "summary", "findings", "month")


def _in_months(day: Column, months: list[str]) -> Column:
    """Whether a day lies in one of the months, as ranges that a scan can use."""
    out = F.lit(False)
    for m in months:
        if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", m):
            raise ValueError(f"a month is yyyy-mm, not {m!r}")
        year, month = int(m[:4]), int(m[5:])
        after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
        out = out | ((day >= F.lit(f"{m}-01").cast("timestamp_ntz")) & (day < F.lit(after).cast("timestamp_ntz")))
    return out


def run(spark: SparkSession, orders: str, output: str, config: dict[str, Any]) -> DataFrame:
    """Audits the change sets of the table at `orders` into `output`; returns the whole output, read back."""
    months, parts = config["months"], config["files_per_month"]
    rows = spark.read.parquet(orders)
    if months:
        rows = rows.where(_in_months(F.col("o_orderdate"), months))
    LOG.info("read %d orders of %s from %s", rows.count(), months or "all months", orders)
    sets = derived.order_changesets(rows, F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    done = gate(sets, derived.gate_corpus(rows), GateConfig.of(config["gate"]), rules=tuple(config["rules"]))
    try:
        audited = done.judged().select(*COLUMNS).repartition("month", F.pmod(F.xxhash64("cs_id"), F.lit(parts)))
        audited.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if months else "static").partitionBy("month").parquet(output)
    finally:
        done.release()
    out = spark.read.schema(AUDIT).parquet(output)
    told = out.where(F.col("month").isin(months)) if months else out
    for r in told.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("findings")).alias("found")).orderBy("band").collect():
        LOG.info("wrote %d change sets, %s, with %d findings, to %s", r["n"], r["band"], r["found"], output)
    return out


def main(arguments: list[str] | None = None) -> None:
    command_line("Audits change sets by month.", {"orders": "the table of orders, Parquet", "output": "the folder of the audit"}, default_file(__file__), run, KNOWN, arguments)


if __name__ == "__main__":
    main()
