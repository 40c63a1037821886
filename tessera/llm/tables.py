"""Reading the tables, and cutting lineage in a folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """The same rows; from now on the session hands Python at most `rows` of them at a time, for texts make long ones."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def whole_key(df: DataFrame, key: str) -> Column:
    """The key column as a long. Keys that aren't whole numbers are refused, not cast."""
    kind = df.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{key} must be a whole number, not {kind.simpleString()}")
    return F.col(key).cast("long")


#: Folders made here, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's own setting; where both are unset, a folder of this machine if Spark runs on it alone, else ValueError."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = sc._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="tessera-tables-")
        folder = _own[sc.applicationId]
    return folder


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder, compressed: what reads it survives lost executors and
    repeats no work. The table goes by drop(), or else when the driver ends. The shuffle files of the job that
    wrote it are of no more use, so Spark is told to remove them once it is done."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of cut() that nothing reads any more."""
    for t in tables:
        files, at = _path(t.sparkSession, t._written)
        files.delete(at, True)


def growing(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, and is never broadcast."""
    return rows.hint("merge")


#: Keys that hold more than this share of all rows are hot; fewer rows than LEAST_HOT never are.
HOT_SHARE, LEAST_HOT = 1 / (1 << 16), 256


def hot_above(rows: int) -> int | None:
    """More rows than this make a key hot. At most 65536 keys of `rows` rows can be, so a table of them may be broadcast. None: there are too few rows for one."""
    return max(LEAST_HOT, int(rows * HOT_SHARE)) if rows > LEAST_HOT else None


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], value: str, spread: str, above: int | None) -> DataFrame:
    """`rows` with the `value`, a few bytes, that `found` (keys, value, n) has for their keys, or null.

    n is at least the number of rows of a key. Keys of more than `above` of them come by broadcast, and their rows
    are dealt by `spread` too in the join that serves the others, so no task gets all rows of a key."""
    if above is None:
        return rows.join(found.select(*keys, value), keys, "left")
    hot = F.broadcast(found.where(F.col("n") > above).select(*keys, F.col(value).alias("_hot")))
    # 0, but no literal: the optimizer would put a literal into the join's condition, and rows would be dealt by the keys alone.
    cold = found.where(F.col("n") <= above).select(*keys, F.col(value).alias("_cold"), F.shiftright(F.col("n").cast("long"), 63).alias("_salt"))
    marked = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread).bitwiseOR(F.lit(1))))
    return marked.join(cold, [*keys, "_salt"], "left").withColumn(value, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_salt")
