"""Where rows go: many even tasks before dear work, and joins that no estimate of sizes may broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks for each core that Spark has: enough that a slow one ends with the others.
TASKS_A_CORE = 4


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The same rows in even tasks, by keys. A scan has as many tasks as its files have row groups, and few bytes of keys may
    stand for long texts: without this a million derived sources are one task's."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def growing(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the input. Sizes of derived tables are estimated from the bytes of the keys that they are
    derived from, far too small, so such a side is never to be broadcast."""
    return rows.hint("merge")
