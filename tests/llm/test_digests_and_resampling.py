"""Exact dedup and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from llm_cases import SCHEMA, WORDS, make
from pyspark.sql import functions as F

from tessera.llm import digests as D
from tessera.llm import resampling as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grouped(rows, keep):
    """(doc_id, keep_id, group_size, sha256) of (doc_id, text)."""
    by = {}
    for i, t in rows:
        by.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t in rows:
        own = by[(t or "").translate(LOWER)]
        real = [x for x in own if x is not None]
        out.append((i, (max if keep == "largest" else min)(real) if real else None, len(own), hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()))
    return sorted(out, key=str)


def held(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("keep", "partitions"), [("smallest", 1), ("largest", 8), ("smallest", 9), ("largest", 70)])
def test_exact_groups(spark, keep, partitions):
    r = random.Random(partitions)
    texts = [r.choice([" ".join(r.choices(WORDS, k=2)), "Hot Copy", "hot copy", "HOT copy", "ÄÖ hot", "äö hot", str(i)]) for i in range(900)]
    rows = [(i * 7 - 3000, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = D.exact_groups(df, keep=keep)
    assert held(got) == grouped([(i, t) for i, t, *_ in rows], keep)
    assert all(x["kept"] == (x["doc_id"] == x["keep_id"]) for x in got.collect())
    assert D.without_copies(df, keep=keep).count() == len({t.translate(LOWER) for t in texts})


def test_exact_groups_of_a_mess(spark, mess):
    for keep in ("smallest", "largest"):
        got = D.exact_groups(mess, keep=keep)
        assert held(got) == grouped([(r["doc_id"], r["text"]) for r in mess.collect()], keep)
        staying = [r["text_sha256"] for r in got.where("kept").collect()]
        assert len(staying) == len(set(staying)) == got.select("text_sha256").distinct().count()
        kept = D.without_copies(mess, keep=keep)
        assert kept.columns == mess.columns and kept.count() >= len(staying)
    assert D.exact_groups(mess.limit(0)).count() == 0 and D.without_copies(mess.limit(0)).columns == mess.columns
    with pytest.raises(TypeError, match="whole number"):
        D.exact_groups(mess.withColumn("doc_id", F.col("doc_id") / 2))
    with pytest.raises(ValueError, match="smallest"):
        D.exact_groups(mess, keep="first")


def test_hot_groups_and_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAF_ROWS", 64)
    rows = spark.range(0, 3000, numPartitions=5).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    for level in (D.leaves(rows), D.merge_round(D.leaves(rows).drop("ids", "places"), 0)):
        assert level.agg(F.sum("n")).first()[0] == 3000
    got = D.exact_groups(rows)
    assert held(got) == grouped([(r["doc_id"], r["text"]) for r in rows.collect()], "smallest")


def test_fold_keeps_digests_that_differ_in_their_last_part_apart():
    def batch(*rows):
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)), pa.array([0] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (4, 5, 6))], names=[*D.DIGEST, "node", "id", "at", "n"])

    got = [r for b in D.fold(iter([batch((1, 2, 3, 4, 10, 0, 2), (1, 2, 3, 4, 11, 1, 1)), batch(), batch((1, 2, 3, 4, 12, 2, 5), (1, 2, 3, 5, 9, 3, 1))])) for r in pa.Table.from_batches([b]).to_pylist()]
    assert [(r["d3"], r["id"], r["n"]) for r in got] == [(4, 10, 8), (5, 9, 1)]


# --- importance resampling


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % R.BUCKETS for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def resampled(rows, target, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank), ranks of equal rows interchangeable."""
    s, t = [0] * R.BUCKETS, [0] * R.BUCKETS
    for x in rows:
        for b in features(x[1])[1]:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + R.BUCKETS) / ((a + 1) * (sum(t) + R.BUCKETS)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([n >= least, (i is None, i or 0), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    chosen = sorted((x for x in out if x[0]), key=lambda x: (-x[4], x[1], x[2], x[3]))
    ranks = [(*x, k + 1 if k < percent * len(chosen) // 100 else None) for k, x in enumerate(chosen)]
    return sorted(((None if x[1][0] else x[1][1], *x[2:]) for x in [*ranks, *((*x, None) for x in out if not x[0])]), key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_importance_resample(spark, monkeypatch, percent):
    r = random.Random(4)
    texts = [" ".join(r.choices(WORDS, k=r.randrange(40))) for _ in range(400)]
    rows = make(texts)
    target = spark.createDataFrame([(i, " ".join(r.choices(WORDS[:5], k=12))) for i in range(20)] + [(99, None)], "item_id long, text string")
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = R.importance_resample(df, target, percent=percent)
    assert ranked(got) == resampled([(i, t) for i, t, *_ in rows], [x["text"] for x in target.collect()], percent)


def test_resampling_of_a_mess(spark, mess):
    target = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in mess.collect()]
    for least in (0, 2):
        got = R.importance_resample(mess, target, percent=60, least_words=least)
        assert ranked(got) == resampled(rows, ["alpha beta"], 60, least)
    assert R.importance_resample(mess.limit(0), target).count() == 0
    assert R.importance_resample(mess, target.limit(0)).count() == len(rows)
    with pytest.raises(TypeError, match="whole number"):
        R.importance_resample(mess.withColumn("doc_id", F.col("doc_id").cast("string")), target)
    with pytest.raises(ValueError, match="percent"):
        R.importance_resample(mess, target, percent=101)


def test_one_id_in_very_many_rows(spark):
    rows = spark.range(0, 4000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("one two " * 15).alias("text"))
    got = ranked(R.importance_resample(rows, rows.limit(1), percent=50))
    assert got == resampled([(r["doc_id"], r["text"]) for r in rows.collect()], ["one two " * 15], 50)


def test_pieces_of_a_text(monkeypatch):
    text = ("word " * 50 + "x" * 300 + ".Y,z é\x00日本 9 ").encode() * 3
    whole = [int(x) for _, h in R.feature_hashes(text) for x in h]
    for n in (1, 7, 64, 1000):
        monkeypatch.setattr(R, "PIECE_BYTES", n)
        parts = list(R.feature_hashes(text))
        assert sorted(int(x) for _, h in parts for x in h) == sorted(whole) and sum(n for n, _ in parts) == len(WORD.findall(text.decode().translate(LOWER)))
    assert sorted(x % R.BUCKETS for x in whole) == sorted(features(text.decode())[1])
