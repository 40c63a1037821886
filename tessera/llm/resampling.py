"""Importance resampling towards a target distribution (DSIR: Xie et al., 2023) with exact, repeatable draws.

A document's features are its words and word pairs, hashed into buckets. One pass counts the
buckets of all documents, another those of the target; a bucket's gain is the logarithm of the
ratio of its shares. Weights are scored from the array of gains, in Arrow batches, and a Gumbel
number from the hash of the id is added, so that the highest scores are a sample without
replacement. Scores are whole numbers of a bounded range: an exact histogram of them comes to the
driver, its suffix sums tell each score's first rank and the score at which the draw ends, and only
documents at or above it are numbered, by id within their score. A score's documents are dealt by
ranges of ids, and rows that are alike in all that is returned travel as one with a count, so no
task gets all rows of a score or of an id.

Defined cases: a null text has no words and no features, so the weight 0; a null id is hashed as
the empty text and comes after all other ids; rows that share id and score are numbered by the
number of features and the weight, rows alike in these too are interchangeable; an empty table
draws nothing; an empty target makes all its shares equal; columns besides key and text are not
read. Keys are whole numbers, else TypeError. Texts are read whole, in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import cut, whole_key
from tessera.llm.wordhash import ALNUM, LOWER

BUCKETS = 10_000
#: Bytes of a text whose words are in work at once.
PIECE_BYTES = 1 << 20
#: Ranges of ids by which the documents of one score are dealt.
RANGES = 64

_PLAIN = bytes(np.where(ALNUM[LOWER], LOWER, 0x20).astype(np.uint8))


def feature_hashes(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """(words, CRC-32 of their features) of consecutive pieces of a text: words, and pairs of neighbours joined by a space."""
    plain, at, before = (text or b"").translate(_PLAIN), 0, None
    while at < len(plain):
        end = plain.find(b" ", at + PIECE_BYTES)
        words, at = plain[at : end if end >= 0 else None].split(), end if end >= 0 else len(plain)
        if not words:
            continue
        own = list(map(crc32, words))
        leading = own[:-1] if before is None else [before, *own[:-1]]
        pairs = map(crc32, words[1:] if before is None else words, map(crc32, repeat(b" "), leading))
        before = own[-1]
        yield len(words), np.fromiter((*own, *pairs), np.int64, len(own) + len(leading))


def bucket_counts(documents: DataFrame, *, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is met in all texts. What comes to the driver is one number a bucket, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column("text"):
                for _, hashes in feature_hashes(x.as_py()):
                    seen += np.bincount(hashes % buckets, minlength=buckets)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(seen[met])], names=["bucket", "n"])

    counted = documents.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over source share, one added to each count, rounded down."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(id_: int | None, seed: int) -> int:
    """Thousandths of a Gumbel number that seed and id decide, rounded down."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "id long, n_features long, weight long, score long, eligible boolean, n long"


def scored(documents: DataFrame, gain: np.ndarray, *, key: str = "doc_id", text: str = "text", seed: int = 7, least_words: int = 20) -> DataFrame:
    """Rows of _SCORED: n of the documents of a batch have this id, number of features, weight and score. Eligible: with `least_words` words or more."""
    rows = documents.select(whole_key(documents, key).alias("id"), F.col(text).cast("binary").alias("text"))
    buckets = len(gain)

    def one(id_: int | None, text: bytes | None) -> tuple:
        words = features = total = 0
        for n, hashes in feature_hashes(text):
            words, features = words + n, features + len(hashes)
            total += int(gain[hashes % buckets].sum())
        weight = total // features if features else 0
        return id_, features, weight, weight + gumbel(id_, seed), words >= least_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike: dict[tuple, int] = {}
            for id_, x in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                row = one(id_, x.as_py())
                alike[row] = alike.get(row, 0) + 1
            columns = [*zip(*alike, strict=True), tuple(alike.values())] if alike else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "n_features", "weight", "score", "eligible", "n"])

    return rows.mapInArrow(run, _SCORED)


def drawn(rows: DataFrame, percent: int) -> DataFrame:
    """`rows` of _SCORED, written already, with `first`: the rank of the first of the n documents, null where the row lies below the draw; a rank may pass the draw's end by the cutoff score's ties."""
    count = {r["score"]: r["n"] for r in rows.where("eligible").groupBy("score").agg(F.sum("n").alias("n")).collect()}
    scores = np.array(sorted(count, reverse=True), np.int64)
    sizes = np.array([count[s] for s in scores.tolist()], np.int64)
    take = percent * int(sizes.sum()) // 100
    above = np.cumsum(sizes) - sizes  # the suffix sums: documents of higher scores
    kept = above < take
    if not kept.any():
        return rows.select("*", F.lit(None).cast("long").alias("first"), F.lit(take).cast("long").alias("take"))
    cutoff = int(scores[kept][-1])
    spark = rows.sparkSession
    # One row for each score of a bounded range, so the broadcast has a proven size.
    offsets = spark.createDataFrame(list(zip(scores[kept].tolist(), above[kept].tolist(), strict=True)), "score long, above long")
    inside = F.col("eligible") & (F.col("score") >= cutoff)
    survivors = rows.where(inside)
    ends = survivors.where("id is not null").agg(F.percentile_approx("id", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    part = sum((F.col("id") > e).cast("int") for e in sorted(set(ends))) if ends else F.lit(0)
    dealt = survivors.withColumn("part", F.when(F.col("id").isNull(), RANGES).otherwise(part))
    held = dealt.groupBy("score", "part").agg(F.sum("n").alias("held"))
    before = held.join(F.broadcast(offsets), "score").select("score", "part", (F.col("above") + F.sum("held").over(Window.partitionBy("score").orderBy("part")) - F.col("held")).alias("before"))
    order = Window.partitionBy("score", "part").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("upto", F.sum("n").over(order)).join(before, ["score", "part"])
    first = F.col("before") + F.col("upto") - F.col("n") + 1
    columns = [*rows.columns]
    ranked = placed.select(*columns, first.alias("first"))
    return ranked.unionByName(rows.where(~inside).select(*columns, F.lit(None).cast("long").alias("first"))).withColumn("take", F.lit(take).cast("long"))


def importance_resample(documents: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = 7, least_words: int = 20, percent: int = 25, buckets: int = BUCKETS) -> DataFrame:
    """Rows (key, n_features, weight, score, rank), one for each document: `percent` of those with `least_words` words or more have a rank."""
    if not 0 <= percent <= 100:
        raise ValueError(f"percent must be from 0 to 100, not {percent!r}")
    gain = gains(bucket_counts(documents, text=text, buckets=buckets), bucket_counts(target, text=target_text, buckets=buckets))
    rows = drawn(cut(scored(documents, gain, key=key, text=text, seed=seed, least_words=least_words)), percent)
    each = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    rank = F.col("first") + F.col("i")
    return each.select(F.col("id").alias(key), "n_features", "weight", "score", F.when(rank <= F.col("take"), rank).alias("rank"))
