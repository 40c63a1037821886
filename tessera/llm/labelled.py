"""Bounded samples of labelled documents for the operators that learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id"):
    """Whether a row's label is kept from learning: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def usable(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """(k, y) of all labels that may be learned from."""
    return labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out("k")).distinct()


def sample(documents: DataFrame, labels: DataFrame, label: str, bound: int, *, others: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (k, text, y, weight): at most `bound` learnable labelled documents, or that many labelled 1
    and `others` labelled 0, least hash of the key first. weight is how many learnable rows of its class a row stands for.

    Null keys and labels other than 0 and 1 teach nothing. The rows of a key that repeats in either
    table count once each for a distinct (text, label).
    """
    known = usable(labels, label, key)
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64("k"), F.col("k")]
    if others is not None:
        chosen = known.where("y = 1").orderBy(*order).limit(bound).unionByName(known.where("y = 0").orderBy(*order).limit(others))
        weight = {y: max(1.0, n / (bound if y else others)) for y, n in total.items()}
    else:
        chosen = known.orderBy(*order).limit(bound)
        weight = {y: max(1.0, sum(total.values()) / bound) for y in total}
    scale = F.lit(1.0)
    for y, w in weight.items():
        scale = F.when(F.col("y") == y, F.lit(float(w))).otherwise(scale)
    # At most bound + others keys and labels: the broadcast has a proven size.
    texts = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "k").distinct().withColumn("weight", scale)
