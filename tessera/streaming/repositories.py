"""A running score for each repository over a stream of its diffs.

A diff that is sent again is not scored again: Spark's state store keeps what came within a delay of
the newest arrival, and forgets what is older than the watermark, so the state is bounded by the
diffs of that time. Each micro-batch writes its scores, and the totals of the batch before with its own
added, each under its batch's number; a batch that is run again after a failure starts from the same
totals and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import GateConfig
from tessera.plans.gate import gate
from tessera.streaming.diffs import parsed

ARRIVALS = "repository string, arrived timestamp, raw string"
SCORES = "repository string, cs_id long, value int, passed boolean"
TOTALS = "repository string, n_scored long, n_failed long, sum_value long, least_value int"


def read_arrivals(spark: SparkSession, path: str, *, files_per_batch: int = 64) -> DataFrame:
    """(repository, arrived, raw, cs_id) of JSON files that arrive below path. Equal diffs have one cs_id."""
    rows = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).json(path)
    return rows.where("raw is not null and arrived is not null").withColumn("cs_id", F.xxhash64("raw"))


def fresh(arrivals: DataFrame, delay: str) -> DataFrame:
    """Of arrivals of one diff in one repository within the delay, the first."""
    return arrivals.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["repository", "cs_id"])


def added(totals: DataFrame | None, scores: DataFrame) -> DataFrame:
    """Totals with the scores of another batch."""
    own = scores.groupBy("repository").agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(~F.col("passed")).alias("n_failed"), F.sum("value").alias("sum_value"), F.min("value").alias("least_value"))
    both = own if totals is None else totals.unionByName(own)
    return both.groupBy("repository").agg(F.sum("n_scored").alias("n_scored"), F.sum("n_failed").alias("n_failed"), F.sum("sum_value").alias("sum_value"), F.min("least_value").alias("least_value"))


def running_scores(arrivals: DataFrame, output: str, checkpoint: str, config: GateConfig | None = None, *, delay: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Scores below output/scores/batch=<n>, totals of all batches so far below output/totals/batch=<n>. Diffs that can't be parsed have no score."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        kept, scores = batch.persist(), f"{output}/scores/batch={n}"
        try:
            if kept.isEmpty():  # a batch that only moves the watermark
                spark.createDataFrame([], SCORES).write.mode("overwrite").parquet(scores)
                return total(spark, n)
            done = gate(*parsed(kept.select("cs_id", "raw")), config)
            try:
                scored = kept.select("repository", "cs_id").join(done.scores.select("cs_id", "value", "passed"), "cs_id")
                scored.write.mode("overwrite").parquet(scores)
            finally:
                done.release()
        finally:
            kept.unpersist()
        total(spark, n)

    def total(spark: SparkSession, n: int) -> None:
        before = spark.read.schema(TOTALS).parquet(f"{output}/totals/batch={n - 1}") if n else None
        added(before, spark.read.schema(SCORES).parquet(f"{output}/scores/batch={n}")).write.mode("overwrite").parquet(f"{output}/totals/batch={n}")

    writer = fresh(arrivals, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_totals(spark: SparkSession, output: str) -> DataFrame:
    """The totals of the last batch."""
    rows = spark.read.schema(f"{TOTALS}, batch long").parquet(f"{output}/totals")
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
