"""Both jobs as queries: the whole tables, two runs into one new folder, what the output then holds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import change_intake, gate_audit
from jobs.settings import default_file, read_config
from tessera.oracles import BREAKS_SQL, FINDINGS


def new_folder(spark: SparkSession, job: str) -> str:
    """A folder of its own below spark.checkpoint.dir or, where that is unset, below the context's checkpoint folder; on one machine alone, below a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not given and of_context.isDefined():
        given = of_context.get()
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        given = tempfile.mkdtemp(prefix="jobs-")
    return f"{given}/jobs/{job}-{uuid.uuid4().hex}"


def job1_gate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = new_folder(spark, "gate_audit"), read_config(default_file(gate_audit.__file__), gate_audit.KNOWN)
    for _ in range(2):
        out = gate_audit.run(spark, f"{sf_dir}/orders.parquet", f"{folder}/audit", config)
    told = F.transform("findings", lambda f: F.concat_ws(" ", f["rule_id"], f["severity"], f["location"], f["title"], F.coalesce(f["justification"], F.lit("-"))))
    return out.withColumn("findings", F.array_join(told, "|"))


def job2_change_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = new_folder(spark, "change_intake"), read_config(default_file(change_intake.__file__), change_intake.KNOWN)
    for _ in range(2):
        # A file stream takes a folder or a pattern; the table may be one file, which this pattern alone matches.
        out = change_intake.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/ledger", f"{folder}/checkpoint", config)
    return out


QUERIES = {"job1_gate_audit": job1_gate_audit, "job2_change_intake": job2_change_intake}

ORACLES = {
    "job1_gate_audit": f"""
      WITH {FINDINGS},
      weighed AS (SELECT *, CASE rule_id WHEN 'VID010' THEN 10 ELSE 20 END AS penalty, CASE rule_id WHEN 'VID010' THEN 'medium' ELSE 'high' END AS severity, path || ':' || bl AS location FROM judged),
      spent AS (
        SELECT cs_id, sum(penalty) FILTER (WHERE justification IS NULL) AS spent, count(*) FILTER (WHERE justification IS NULL) AS n, max(penalty) FILTER (WHERE justification IS NULL) AS worst,
          string_agg(concat_ws(' ', rule_id, severity, location, title, coalesce(justification, '-')), '|' ORDER BY penalty DESC, rule_id, location, file_ord, title) AS findings
        FROM weighed GROUP BY cs_id
      ),
      audit AS (
        SELECT o_orderkey AS cs_id, CAST(greatest(0, 100 - coalesce(spent, 0)) AS INTEGER) AS value, coalesce(n, 0) AS n_unjustified, CASE worst WHEN 20 THEN 'high' WHEN 10 THEN 'medium' END AS worst_severity, coalesce(findings, '') AS findings, strftime(o_orderdate, '%Y-%m') AS month
        FROM orders LEFT JOIN spent ON cs_id = o_orderkey
      ),
      banded AS (SELECT *, CASE WHEN value >= 90 THEN 'trusted' WHEN value >= 80 THEN 'acceptable' WHEN value >= 40 THEN 'suspect' ELSE 'untrusted' END AS band FROM audit)
      SELECT *, 80 AS threshold, value >= 80 AS passed,
        'Trust ' || value || '/100 (' || band || ') — ' || CASE WHEN n_unjustified = 0 THEN 'no verification loss detected' WHEN n_unjustified = 1 THEN '1 unjustified finding' ELSE n_unjustified || ' unjustified findings' END AS summary
      FROM banded""",
    "job2_change_intake": rf"""
      WITH d AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/test_' || doc_id || ['.py', '.ts', '.js', '.txt', '.pyi', '.spec.tsx'][doc_id % 6 + 1] AS path, regexp_split_to_array(coalesce(text, ''), '{BREAKS_SQL}') AS parts FROM documents),
      l AS (SELECT *, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines FROM d),
      x AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: (doc_id + i) % 7 = 0) AS gone, list_filter(range(1, len(lines) + 1), lambda i: (doc_id + i) % 7 <> 0 AND (doc_id + i) % 11 = 0) AS more FROM l)
      SELECT doc_id AS cs_id, path, 'modified' AS kind,
        NOT starts_with(path, 'src2/') AND regexp_matches(path, '(/test_[^/]*\.py|\.(test|spec)\.(ts|tsx|js|jsx))$') AS is_test, CAST(len(lines) > 0 AS INTEGER) AS n_hunks,
        len(gone) AS n_removed, len(more) AS n_added, CAST(gone[1] AS INTEGER) AS first_removed, sha256(array_to_string(list_transform(gone, lambda i: lines[i]), chr(10))) AS removed_sha256,
        sha256(array_to_string(list_transform(more, lambda i: 'note ' || i), chr(10))) AS added_sha256, CAST(NULL AS VARCHAR) AS parse_error,
        CASE WHEN suffix(path, '.pyi') OR suffix(path, '.py') THEN 'python' WHEN suffix(path, '.tsx') THEN 'tsx' WHEN suffix(path, '.ts') THEN 'typescript' WHEN suffix(path, '.js') THEN 'javascript' ELSE 'none' END AS language
      FROM x""",
}
