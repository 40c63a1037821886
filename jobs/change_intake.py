"""Takes in text changes as they arrive and keeps a ledger of them, by language.

Reviewers need to know of each change which file it touches, whether that is a test file, and what
was taken away. The job follows a folder of documents as a file stream: each document is a changed
file, rendered as one unified diff over its whole text, parsed by the library's diff parser, and
summed up in one row, below `language=<language>`. A diff that can't be parsed is a row with its
error; the others aren't stopped by it.

The checkpoint says which files were taken, so a run takes only those that are new, in batches of
`files_per_batch` files, and ends when there are no more (availableNow). Spark's file sink writes a
batch once, also when it must be run again: its list of batches is what readers of the output
follow. A rerun without new files adds nothing. Every file counts, old ones that arrive late too.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import command_line, default_file
from tessera.config import GateConfig
from tessera.functions.lines import joined, side_lines
from tessera.functions.paths import detect_language, is_test_path
from tessera.plans import derived
from tessera.sources.unified_diff import read_diffs

LOG = logging.getLogger("jobs.change_intake")
KNOWN: dict[str, Any] = {"files_per_batch": 64, "ignore_globs": []}
LEDGER = "cs_id long, path string, kind string, is_test boolean, n_hunks int, n_removed long, n_added long, first_removed int, removed_sha256 string, added_sha256 string, parse_error string, language string"
#: Files older than the newest one by more than this would not be taken in: as good as none.
MOST_AGE = "36500d"


def ledger(diffs: DataFrame, config: GateConfig) -> DataFrame:
    """Rows of LEDGER for diffs (cs_id, raw), batch or stream."""
    h, path = F.coalesce("hunks", F.expr("cast(array() as array<struct<base_start:int,base_lines:int,head_start:int,head_lines:int,added:array<struct<line:int,text:string>>,removed:array<struct<line:int,text:string>>>>)")), F.col("path")
    rows = read_diffs(diffs).withColumn("h", h).withColumn("removed", side_lines(F.col("h"), "base")).withColumn("added", side_lines(F.col("h"), "head"))
    return rows.select(
        "cs_id", "path", "kind", F.coalesce(is_test_path(path, config), F.lit(False)).alias("is_test"), F.size("h").alias("n_hunks"), F.size("removed").cast("long").alias("n_removed"), F.size("added").cast("long").alias("n_added"),
        F.get("removed", F.lit(0))["line"].alias("first_removed"), F.sha2(joined(F.col("removed")), 256).alias("removed_sha256"), F.sha2(joined(F.col("added")), 256).alias("added_sha256"), "parse_error",
        F.coalesce(detect_language(path), F.lit("none")).alias("language"),
    )


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict[str, Any]) -> DataFrame:
    """Takes the new files below `documents` into `output`; returns the whole output, read back."""
    known = spark.read.parquet(documents).schema
    arriving = spark.readStream.schema(known).option("maxFilesPerTrigger", config["files_per_batch"]).option("maxFileAge", MOST_AGE).parquet(documents)
    rows = ledger(derived.document_diffs(arriving), GateConfig(ignore_globs=tuple(config["ignore_globs"])))
    query = rows.writeStream.format("parquet").partitionBy("language").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p.numInputRows]
    LOG.info("read %d documents in %d batches from %s", sum(p.numInputRows for p in batches), len(batches), documents)
    out = spark.read.schema(LEDGER).parquet(output)
    for r in out.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count("parse_error").alias("bad")).orderBy("language").collect():
        LOG.info("%s holds %d changes in %s, %d of them unreadable", output, r["n"], r["language"], r["bad"])
    return out


def main(arguments: list[str] | None = None) -> None:
    command_line("Takes in text changes as they arrive.", {"documents": "the folder of documents, Parquet, or a pattern of files", "output": "the folder of the ledger", "checkpoint": "the stream's checkpoint"}, default_file(__file__), run, KNOWN, arguments)


if __name__ == "__main__":
    main()
