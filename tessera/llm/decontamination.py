"""Benchmark decontamination as a prefix-filtered containment join.

Benchmark items become windows of `size` consecutive words (a shorter item is one window). A
window is a set of word-pair shingles that a document must contain wholly. The join's steps:

1. Rarity: one pass counts each benchmark shingle in all documents; counts are summed by Spark.
2. Necessary prefix: at containment 1 the prefix of a window, with shingles ordered by rarity, is
   its rarest shingle. Only documents that have it can contain the window.
3. Positional and length bounds: the shingle's offset in the window fixes where the window would
   start in the document; it must start at 0 or later and end by the document's last word.
4. Verification: the hash of all words of the window, then the words themselves, byte by byte.

Documents are never shuffled. The windows are taken in blocks of about BLOCK_WINDOWS, each small
enough to be broadcast whatever the benchmark's size; a larger benchmark means more blocks, which
a document passes one after the other carrying what it has been hit by, so no size is refused.

Defined cases: null texts have no words and hit nothing; an item without words has no window; a
null item id takes part in hits but isn't listed; repeated documents give a row each; repeated
items are listed once by id; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import cut, small_batches
from tessera.llm.wordhash import ALNUM, grams, mix, whole, words

BLOCK_WINDOWS = 50_000


def _schema(rows: DataFrame) -> T.StructType:
    hit = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    return T.StructType([*rows.schema, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(hit)), T.StructField("items", T.ArrayType(T.StringType()))])


@dataclass
class Block:
    """Windows: the words of each, joined by a space, their count, the items that have it, and its prefix."""

    text: list[bytes]
    length: np.ndarray
    whole_hash: np.ndarray
    items: list[list[str]]
    shingles: np.ndarray  # sorted hashes of all shingles
    prefix: np.ndarray  # sorted hashes of the prefixes
    window: np.ndarray  # the window of each
    offset: np.ndarray  # where in the window it is


def _pairs(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The shingle at each word: its word pair, or the word alone at the end of a text, which is looked up for one-word windows only."""
    two = grams(h, 2)
    return np.where(whole(cut, 2, len(two)), two, np.uint64(0))


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, lengths = [], [], []
            for w in words(b.column("text"), ALNUM, lower=True):
                for k in range(w.texts):
                    own = [w.word(i) for i in range(w.cut[k], w.cut[k + 1])]
                    item = b.column("item")[w.first + k].as_py()
                    for at in range(max(1, len(own) - size + 1)) if own else ():
                        part = own[at : at + size]
                        ids.append(item)
                        texts.append(b" ".join(part).decode())
                        lengths.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(lengths, pa.int32())], names=["item", "window", "n"])

    return run


def _chained(h: np.ndarray, n: int) -> np.ndarray:
    return grams(h, n, salt=n)


def _block(rows: list) -> Block:
    """A block without its prefixes."""
    text = [r["window"].encode() for r in rows]
    length = np.array([r["n"] for r in rows], np.int64)
    hashes, shingles = np.zeros(len(rows), np.uint64), []
    for i, h in enumerate(_word_hashes(text)):
        hashes[i] = _chained(h, len(h))[0]
        shingles.append(grams(h, 2) if len(h) > 1 else mix(h))
    every = np.unique(np.concatenate(shingles)) if shingles else np.zeros(0, np.uint64)
    b = Block(text, length, hashes, [sorted(x for x in r["items"] if x is not None) for r in rows], every, every[:0], length[:0], length[:0])
    b.own = shingles
    return b


def _word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    for w in words(pa.array([t.decode() for t in texts], pa.string()), ALNUM, lower=True):
        h = w.hashes()
        yield from np.split(h, w.cut[1:-1])


def _ordered(b: Block, counts: dict[int, int]) -> Block:
    """With the rarest shingle of each window as its prefix; ties go to the smaller hash."""
    pick = []
    for own in b.own:
        rarity = np.array([counts.get(int(np.int64(np.uint64(x).view(np.int64))), 0) for x in own])
        pick.append(int(np.lexsort((own, rarity))[0]))
    prefix = np.array([own[i] for own, i in zip(b.own, pick, strict=True)], np.uint64)
    at = np.argsort(prefix, kind="stable")
    b.prefix, b.window, b.offset = prefix[at], at, np.array(pick, np.int64)[at]
    del b.own
    return b


def _found(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in x of values that are among the keys. A bit table of fixed size is asked first."""
    bits = np.zeros(1 << 20, bool)
    bits[(sorted_keys >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(bits[(x >> np.uint64(44)).astype(np.int64)])
    if not len(at):
        return at
    i = np.minimum(np.searchsorted(sorted_keys, x[at]), len(sorted_keys) - 1)
    return at[sorted_keys[i] == x[at]]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value.shingles
        total = np.zeros(len(keys), np.int64)
        for b in batches:
            for w in words(b.column("text"), ALNUM, lower=True):
                h = w.hashes()
                for x in (_pairs(h, w.cut), mix(h)):
                    total += np.bincount(np.searchsorted(keys, x[_found(keys, x)]), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)[total > 0]), pa.array(total[total > 0])], names=["shingle", "n"])

    return run


def _join(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        singles = bool((block.length == 1).any())
        for b in batches:
            n_words = np.zeros(b.num_rows, np.int64)
            hits, items = b.column("hits").to_pylist(), b.column("items").to_pylist()
            for w in words(b.column("text"), ALNUM, lower=True):
                n_words[w.first : w.first + w.texts] = np.diff(w.cut)
                h = w.hashes()
                candidates = [(p, _found(block.prefix, p)) for p in ([_pairs(h, w.cut), mix(h)] if singles else [_pairs(h, w.cut)])]
                for p, at in candidates:
                    if not len(at):
                        continue
                    low, high = np.searchsorted(block.prefix, p[at], "left"), np.searchsorted(block.prefix, p[at], "right")
                    each = np.repeat(np.arange(len(at)), high - low)
                    which = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
                    win, start = block.window[which], at[each] - block.offset[which]
                    text = np.searchsorted(w.cut, at[each], "right") - 1
                    fits = (start >= w.cut[text]) & (start + block.length[win] <= w.cut[text + 1])
                    win, start, text = win[fits], start[fits], text[fits]
                    for n in np.unique(block.length[win]):
                        own = np.flatnonzero(block.length[win] == n)
                        value = np.full(len(own), np.uint64(int(n) * 2 + 1))
                        for j in range(n):
                            value = value * np.uint64(0x9FB21C651E98DF25) + h[start[own] + j]
                        for i in own[mix(value) == block.whole_hash[win[own]]]:
                            s = int(start[i])
                            if b" ".join([w.word(s + j) for j in range(n)]) == block.text[win[i]]:
                                k = int(text[i])
                                hits[w.first + k].append({"start": s - int(w.cut[k]), "stop": s - int(w.cut[k]) + int(n)})
                                items[w.first + k].extend(block.items[win[i]])
            for k, x in enumerate(hits):
                if len(x) > 1:
                    hits[k] = _merged(x)
                items[k] = sorted(set(items[k]))
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("text"), b.column("rest"), pa.array(n_words), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                names=["k", "text", "rest", "n_words", "hits", "items"],
            )

    return run


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], s["stop"])
        else:
            out.append(dict(s))
    return out


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, *, size: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS, carry: bool = False) -> DataFrame:
    """Rows (key, text, n_words, hits, items): merged word spans of each document that benchmark windows cover, and the items they are of.

    With `carry`, a last struct column `rest` has the other columns."""
    sc = documents.sparkSession.sparkContext
    # Read for its count and for every block.
    windows = cut(
        benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
        .mapInArrow(_windows(size), "item string, window string, n int")
        .groupBy("window", "n")
        .agg(F.collect_set("item").alias("items"))
    )
    blocks = max(1, -(-windows.count() // block_windows))
    # The other columns pass by in one struct, so their names can't clash with the operator's.
    others = F.struct(*[documents[c] for c in documents.columns if c not in (key, text)], F.lit(0).alias("_")) if carry else F.lit(0)
    rows = small_batches(documents).select(F.col(key).alias("k"), F.col(text).alias("text"), others.alias("rest"))
    schema = _schema(rows)
    out = rows.select("k", "text", "rest", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    for i in range(blocks):
        # About block_windows rows reach the driver at a time, never the whole of a larger benchmark.
        block = _block(windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i).collect())
        shared = sc.broadcast(block)
        counted = rows.mapInArrow(_count(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect() if len(block.shingles) else []
        joined = sc.broadcast(_ordered(block, {r["shingle"]: r["n"] for r in counted}))
        out = out.mapInArrow(_join(joined), schema)
    return (out if carry else out.drop("rest")).withColumnRenamed("k", key)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `documents`, all columns as they are, that no benchmark window hits."""
    clean = benchmark_hits(documents, benchmark, key=key, text=text, carry=True, **how).where(F.size("hits") == 0)
    return clean.select(*[F.col(c) if c in (key, text) else F.col("rest").getField(c).alias(c) for c in documents.columns])


def n_hit(hits: str = "hits"):
    """Words inside merged spans."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
