"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

`shard_documents` sends each row to a shard that depends on its key and the number of shards
alone, without a ring table: when a shard is appended, a row stays or goes to the new shard.
The jumps run in numpy over whole Arrow batches. Slots are numbered without a gap inside each
shard by (bucket, key, size, checksum); a bucket is a value of the key's hash, so the numbering
is a small count per (shard, bucket) plus a row number inside it, and no task gets a whole shard.
Where an order is given, as a column `run` (a piece of the order) and a column `place` inside it, the
slots of each shard follow (run, place) instead, numbered from counts per (shard, run).

Defined cases: a null key is hashed as the key 0 and keeps its null; a null text has no bytes
and the checksum 0 of nothing; repeated rows get slots of their own; an empty table gives an
empty result; columns besides the key and the text are not read. Keys are whole numbers, else TypeError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import whole_key

_U = np.uint64
#: The multiplier of the published generator.
_MULTIPLIER = _U(2862933555777941757)
BUCKETS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, below `shards`, of each 64-bit key."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = keys.astype(np.int64).view(_U).copy()
    shard, at = np.zeros(len(key), np.int64), np.arange(len(key))
    landing = np.zeros(len(key), np.int64)
    while len(at):
        shard[at] = landing[at]
        key[at] = key[at] * _MULTIPLIER + _U(1)
        landing[at] = ((shard[at] + 1) * ((1 << 31) / ((key[at] >> _U(33)) + _U(1)).astype(np.float64))).astype(np.int64)
        at = at[landing[at] < shards]
    return shard


def shard_documents(documents: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", overhead: int = 16, run: Column | None = None, place: Column | None = None) -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard), one for each row of `documents`; `run` and `place` go together."""
    if (run is None) != (place is None):
        raise ValueError("run and place go together")
    kind = documents.schema[key].dataType.simpleString()
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    given = [] if run is None else [run.cast("string").alias("run"), place.cast("long").alias("place")]
    whole_key(documents, key)
    sized = documents.select(F.col(key).alias("k"), (F.octet_length(body).cast("long") + overhead).alias("size"), F.crc32(body).alias("text_crc32"), *given)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("k").fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            spread = (k.view(_U) * _MULTIPLIER + _U(1)) >> _U(64 - int(math.log2(BUCKETS)))
            more = (jump_hash(k, shards).astype(np.int32), jump_hash(k, shards + 1).astype(np.int32), spread.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more)], names=[*b.schema.names, "shard", "grown_shard", "bucket"])

    placed = sized.mapInArrow(place, f"k {kind}, size long, text_crc32 long, {'run string, place long, ' if given else ''}shard int, grown_shard int, bucket int")
    if given:
        # A row for each shard and run; a run is a bounded piece of the order, so neither a task nor a window gets a whole shard's rows.
        counts = placed.groupBy("shard", "run").count()
        starts = counts.select("shard", "run", (F.sum("count").over(Window.partitionBy("shard").orderBy("run")) - F.col("count")).alias("from"))
        numbered = placed.withColumn("row", F.row_number().over(Window.partitionBy("shard", "run").orderBy("place"))).join(starts, ["shard", "run"])
        return _slots(numbered, key)
    # At most shards * BUCKETS rows, whatever the input.
    counts = placed.groupBy("shard", "bucket").count()
    starts = counts.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("from"))
    numbered = placed.withColumn("row", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.col("k").asc_nulls_first(), "size", "text_crc32")))
    # The bound on the rows is a parameter of the module, so the broadcast has a proven size.
    return _slots(numbered.join(F.broadcast(starts), ["shard", "bucket"]), key)


def _slots(numbered: DataFrame, key: str) -> DataFrame:
    return numbered.select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("from") + F.col("row") - 1).cast("long").alias("slot"), "grown_shard"
    )
