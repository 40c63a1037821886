"""A stream of diffs through the stateless plan.

Every finding is local to one change set, and a diff is one row, so a micro-batch needs nothing of
another: there is no state, no watermark and no late data. Each batch is scored and written once
under its batch id, so a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import GateConfig
from tessera.plans.gate import gate
from tessera.sources.unified_diff import read_diffs


def read_diff_stream(spark: SparkSession, path: str) -> DataFrame:
    """(cs_id, raw) of diff files that arrive below path, one diff each. Equal diffs have one cs_id: they are one change set."""
    return spark.readStream.format("text").option("wholetext", "true").load(path).select(F.xxhash64("value").alias("cs_id"), F.col("value").alias("raw"))


def parsed(diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changesets, file_changes) of diffs, without contents. A cs_id that comes again in a batch is read once."""
    diffs = diffs.dropDuplicates(["cs_id"])
    rows = read_diffs(diffs)
    none = F.lit(None).cast("string")
    files = rows.where(F.col("parse_error").isNull()).select("cs_id", "file_ord", "path", "kind", "base_path", none.alias("base_content"), none.alias("head_content"), "is_binary", "hunks")
    errors = rows.where(F.col("parse_error").isNotNull()).select("cs_id", "parse_error")
    sets = diffs.select("cs_id").join(errors, "cs_id", "left").select("cs_id", none.alias("base_ref"), none.alias("head_ref"), F.expr("cast(array() as array<string>)").alias("commit_messages"), "parse_error")
    return sets, files


def score_stream(diffs: DataFrame, output: str, checkpoint: str, config: GateConfig | None = None, *, available_now: bool = True) -> StreamingQuery:
    """Scores of each micro-batch as Parquet below output/batch=<id>."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sets, files = parsed(batch)
        done = gate(sets, files, config)
        try:
            done.scores.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        finally:
            done.release()

    writer = diffs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
