"""A corpus pipeline: STAGES in order, each a table made of the whole table before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard, mixing, sharding, toxicity
from tessera.llm.tables import cut, small_batches, table

SHARDS = 40
RUN = 1 << 16


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go. What is learned comes from the labelled ones among `docs`."""
    return toxicity.without_toxic(small_batches(docs), toxicity.build(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles, the document with the smallest id stays."""
    return jaccard.one_of_each(small_batches(docs))


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontamination.without_contaminated(small_batches(docs), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources' blocks are scheduled."""
    return mixing.in_mixed_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: shard, slot, and the shard with one more shard. The slots of a shard follow the order in which `docs` were written."""
    return sharding.shard_documents(small_batches(docs), SHARDS, run=written_run(), place=F.col("_metadata.row_index"))


def written_run() -> Column:
    """Pieces of at most RUN rows of a written table, as text that sorts in the order of writing: files are numbered by partition."""
    return F.concat_ws("/", F.col("_metadata.file_name"), F.lpad((F.col("_metadata.row_index") / RUN).cast("long").cast("string"), 12, "0"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: The first stage learns from labels, which SQL can't express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
