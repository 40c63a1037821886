"""A quality classifier by Bradley-Terry pairwise ranking.

Every text becomes a fixed vector of FEATURES, counted over its whole bytes and words: its shape, and
its content as the roots of the shares of words and of three-byte sequences by hash bin. All learnable
labelled rows are learned from. Up to SAMPLE of them are fitted on the driver, on PAIRS preference pairs
(a document labelled 1 over one labelled 0) that are drawn by a fixed seed. More are dealt to blocks, in
which every 1 is paired with every 0, and fitted by sums over the blocks, a Spark job for each step. The
chance that a document is preferred is the logistic function of the difference of two scores, and the
weights minimise that logistic loss on feature differences (with a small ridge, by Newton steps). Scores
are thresholded at the quantile of all learnable rows' scores that their share of 0 labels names; a scale
fitted on the same rows makes 0.5 that threshold and the score a probability.

Defined cases: null and empty texts are the zero counts, with a finite score; repeated rows get equal
scores; without labels, or with one class alone, every score is that class's share (0.5 without
labels); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, sample, usable
from tessera.llm.tables import cut, drop, growing
from tessera.llm.wordhash import BLANK_SEPARATED, LOWER, U, grams, string_buffers, whole, words

SAMPLE = 8000
PAIRS = 40_000
RIDGE = 1e-3

_KIND = np.zeros(256, np.int8)  # 0 other
_KIND[65:91] = 1  # upper-case
_KIND[97:123] = 2  # lower-case
_KIND[48:58] = 3  # digits
_KIND[[46, 44, 59, 58, 33, 63, 34, 39, 45, 40, 41]] = 4  # usual punctuation
_KIND[[*range(35, 39), 42, 43, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)]] = 5  # symbols
_KIND[[9, 11, 12, 13, 32]] = 6
_KIND[10] = 7
_KIND[128:] = 8

WORD_BINS, GRAM_BINS = 64, 64
FEATURES = (
    "log_words", "upper", "digit", "punctuation", "symbol", "line_end", "wide", "shout",
    "symbol_words", "upper_words", "bare_symbol_words", "short_words", "long_words", "mean_length",
    "distinct_words", "repeated_pairs", "log_line_words", "symbol_squared", "upper_squared", "distinct_squared",
    *(f"word_{i}" for i in range(WORD_BINS)), *(f"gram_{i}" for i in range(GRAM_BINS)),
)


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(column), len(FEATURES)))
    for w in words(column, BLANK_SEPARATED, lower=False):
        kinds = _KIND[w.buf]
        offsets = np.zeros(w.texts + 1, np.int64)
        # Where the texts lie in the chunk: words give it only for texts that have some.
        offsets[1:] = np.cumsum(_byte_lengths(column, w))
        text = np.repeat(np.arange(w.texts), np.diff(offsets))
        counts = np.bincount(text * 9 + kinds, minlength=9 * w.texts).reshape(-1, 9).astype(float)
        letters = np.maximum(1, counts[:, 1] + counts[:, 2] + counts[:, 8])
        visible = np.maximum(1, counts.sum(1) - counts[:, 6] - counts[:, 7])
        shout = np.bincount(text[w.buf == 33], minlength=w.texts)
        owner = w.text_of()
        n = np.bincount(owner, minlength=w.texts).astype(float)
        some = np.maximum(1, n)
        size = w.end - w.start
        kind_sums = [np.concatenate([[0], np.cumsum(kinds == k)]) for k in (1, 2, 5)]
        upper, lower, symbol = (c[w.end] - c[w.start] for c in kind_sums)

        def share(mask, owner=owner, some=some, texts=w.texts):
            return np.bincount(owner[mask], minlength=texts) / some

        h = w.hashes()
        distinct = _distinct(owner, h, w.texts)
        two = grams(h, 2)
        inside = whole(w.cut, 2, len(two))
        pairs = np.maximum(1, np.bincount(owner[: len(two)][inside], minlength=w.texts))
        f = out[w.first : w.first + w.texts]
        f[:, 0] = np.log1p(n)
        f[:, 1] = counts[:, 1] / letters
        f[:, 2] = counts[:, 3] / visible
        f[:, 3] = counts[:, 4] / visible
        f[:, 4] = counts[:, 5] / visible
        f[:, 5] = counts[:, 7] / some
        f[:, 6] = counts[:, 8] / visible
        f[:, 7] = shout / some
        f[:, 8] = share(symbol > 0)
        f[:, 9] = share((upper >= 2) & (lower == 0))
        f[:, 10] = share(symbol == size)
        f[:, 11] = share(size <= 3)
        f[:, 12] = share(size >= 12)
        f[:, 13] = np.bincount(owner, weights=size, minlength=w.texts) / some / 10
        f[:, 14] = distinct / some
        f[:, 15] = 1 - _distinct(owner[: len(two)][inside], two[inside], w.texts) / pairs
        f[:, 16] = np.log1p(n / (1 + counts[:, 7]))
        bins = np.bincount(owner * WORD_BINS + (h >> U(58)).astype(np.int64), minlength=w.texts * WORD_BINS)
        f[:, 20 : 20 + WORD_BINS] = np.sqrt(bins.reshape(-1, WORD_BINS) / some[:, None])
        f[:, 20 + WORD_BINS :] = _gram_shares(w, text)
        f[:, 17], f[:, 18], f[:, 19] = np.sqrt(f[:, 8]), np.sqrt(f[:, 9]), f[:, 14] * f[:, 0]
    return out


def _gram_shares(w, text: np.ndarray) -> np.ndarray:
    """Roots of the shares of three-byte sequences, lower-cased, by hash bin."""
    x = LOWER[w.buf].astype(np.uint32)
    gram = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    own = text[:-2] == text[2:]
    of, gram = text[:-2][own], gram[own]
    bins = np.bincount(of * GRAM_BINS + (gram * np.uint32(2654435761) >> np.uint32(26)).astype(np.int64), minlength=w.texts * GRAM_BINS).reshape(-1, GRAM_BINS)
    return np.sqrt(bins / np.maximum(1, bins.sum(1))[:, None])


def _byte_lengths(column: pa.Array, w) -> np.ndarray:
    offsets, _ = string_buffers(column.slice(w.first, w.texts))
    return np.diff(offsets)


def _distinct(owner: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    at = np.lexsort((h, owner))
    o, x = owner[at], h[at]
    fresh = np.ones(len(o), bool)
    fresh[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    return np.bincount(o[fresh], minlength=texts)


@dataclass
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    constant: float | None = None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) * self.scale, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = PAIRS, seed: int = 7) -> Ranker:
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = len(FEATURES)
    r = Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    if not len(good) or not len(bad):
        r.constant = float(y.mean()) if len(y) else 0.5
        return r
    r.mean, r.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - r.mean) / r.spread, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        g = -(d.T @ p) / pairs + RIDGE * w
        h = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(width)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    r.weights = w
    s = z @ w
    share = len(bad) / len(y)
    r.threshold = float((np.quantile(s, share, method="lower") + np.quantile(s, share, method="higher")) / 2)
    # One logistic slope about the threshold.
    t, a = s - r.threshold, 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * t, -500, 500)))
        grad, curve = float(t @ (p - y)) + 1e-2 * (a - 1), float((t * t) @ (p * (1 - p))) + 1e-2
        a = max(1e-3, a - grad / curve)
    r.scale = float(a)
    return r


def _vectors(documents: DataFrame, labels: DataFrame, label: str, key: str, text: str) -> DataFrame:
    """Rows (k, y, x) of all learnable labelled documents, once for each distinct (key, text, label). Vectors are made where the texts are, so no text is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), pa.array(list(features(b.column("text")).astype(np.float32)), pa.list_(pa.float32()))], names=["k", "h", "x"])

    body = F.coalesce(F.col(text), F.lit(""))
    learnable = documents.select(F.col(key).cast("long").alias("k"), F.sha1(body.cast("binary")).alias("h"), body.alias("text")).where(F.col("k").isNotNull() & ~held_out("k"))
    found = learnable.mapInArrow(run, "k long, h string, x array<float>")
    return found.join(growing(usable(labels, label, key).withColumn("k", F.col("k").cast("long"))), "k").groupBy("k", "y", "h").agg(F.first("x").alias("x")).drop("h")


#: Rows of a block, of them at least so many of the rarer class; tasks that send their sums to the driver at once.
BLOCK, RARE, SUMS = 512, 32, 64


def _blocks(vectors: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Rows (y, own, x): all vectors in blocks, dealt by hash. Of a class too rare for all blocks each row goes to several, and is `own` in one."""
    n = -(-sum(counts.values()) // BLOCK)
    rare = min(counts, key=lambda y: counts[y])
    copies = F.when(F.col("y") == rare, F.lit(min(n, max(1, -(-RARE * n // counts[rare]))))).otherwise(1)
    each = vectors.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    block = F.pmod(F.xxhash64("k") + F.col("copy") * F.lit(7919), F.lit(n))
    rows = each.groupBy(block.alias("block")).agg(F.collect_list(F.struct("k", "copy", "y", "x")).alias("r")).select(F.array_sort("r").alias("r"))
    return rows.select(F.transform("r", lambda r: r["y"]).alias("y"), F.transform("r", lambda r: r["copy"] == 0).alias("own"), F.flatten(F.transform("r", lambda r: r["x"])).alias("x"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(y, own, x) of each block."""
    for b in batches:
        for y, own, x in zip(b.column("y"), b.column("own"), b.column("x"), strict=True):
            yield y.values.to_numpy(), own.values.to_numpy(zero_copy_only=False), x.values.to_numpy().reshape(-1, len(FEATURES)).astype(float)


def _summed(blocks: DataFrame, one: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of an array made of each; a task sends one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for y, own, x in _each(batches):
            out += one(y, own, x)
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["s"])

    return np.sum([r["s"] for r in blocks.coalesce(SUMS).mapInArrow(run, "s array<double>").collect()], axis=0)


def _preferred(w: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> Callable:
    """Of a block: pairs, gradient and curvature of the loss over all its pairs of a 1 with a 0, none written out."""

    def one(y: np.ndarray, own: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / spread, -8, 8)
        good, bad = z[y == 1], z[y == 0]
        p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None, :], -500, 500)))
        q = p * (1 - p)
        cross = good.T @ q @ bad
        curve = good.T @ (good * q.sum(1)[:, None]) + bad.T @ (bad * q.sum(0)[:, None]) - cross - cross.T
        return np.concatenate([[p.size], p.sum(0) @ bad - p.sum(1) @ good, curve.ravel()])

    return one


def _at_ranks(scores: DataFrame, rank: int, bins: int = 4096, few: int = 10_000) -> float:
    """The value of a rank, from 0, among the scores: counts by bin narrow the range until few values are left."""
    rows = scores.select("s")
    while True:
        low, high, n = rows.agg(F.min("s"), F.max("s"), F.count("s")).first()
        if low == high:
            return low
        if n <= few:
            return sorted(r["s"] for r in rows.collect())[rank]
        at = F.least(F.floor((F.col("s") - low) / (high - low) * bins), F.lit(bins - 1))
        for b, count in sorted((r["b"], r["count"]) for r in rows.groupBy(at.alias("b")).count().collect()):
            if rank < count:
                break
            rank -= count
        rows = rows.where(at == b)


def fit_all(vectors: DataFrame, counts: dict[int, int]) -> Ranker:
    """The ranker over all vectors, however many: what fit() does on the driver, by sums over blocks of rows. Every row meets all rows of the other class of its block."""
    width, n = len(FEATURES), sum(counts.values())
    r = Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    blocks = cut(_blocks(vectors, counts))
    moments = _summed(blocks, lambda y, own, x: np.concatenate([x[own].sum(0), (x[own] ** 2).sum(0)]), 2 * width) / n
    r.mean = moments[:width]
    r.spread = np.maximum(np.sqrt(np.maximum(moments[width:] - r.mean**2, 0)), 1e-6)
    w = r.weights
    for _ in range(40):
        sums = _summed(blocks, _preferred(w, r.mean, r.spread), 1 + width + width * width)
        pairs, g, h = sums[0], sums[1 : 1 + width], sums[1 + width :].reshape(width, width)
        step = np.linalg.solve(h / pairs + RIDGE * np.eye(width), g / pairs + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    r.weights = w

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, own, x in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(r.strength(x)[own]), pa.array(y[own].astype(np.int32))], names=["s", "y"])

    scores = cut(blocks.mapInArrow(strengths, "s double, y int"))
    place = counts[0] / n * (n - 1)
    r.threshold = (_at_ranks(scores, int(np.floor(place))) + _at_ranks(scores, int(np.ceil(place)))) / 2
    t, a = F.col("s") - r.threshold, 1.0
    for _ in range(60):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), t * a))))
        grad, curve = scores.agg(F.sum(t * (p - F.col("y"))), F.sum(t * t * p * (1 - p))).first()
        before, a = a, max(1e-3, a - (grad + 1e-2 * (a - 1)) / (curve + 1e-2))
        if abs(a - before) < 1e-9 * a:
            break
    r.scale = float(a)
    drop(blocks, scores)
    return r


def train(documents: DataFrame, labels: DataFrame, *, label: str = "quality", bound: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Ranker:
    """The ranker of all learnable labelled rows. Up to `bound` of them are fitted on the driver, more by Spark."""
    n = usable(labels, label, key).limit(bound + 1).count()
    if n > bound:
        vectors = cut(_vectors(documents, labels, label, key, text))
        counts = {r["y"]: r["count"] for r in vectors.groupBy("y").count().collect()}
        try:
            if len(counts) == 1:
                return fit(np.zeros((1, len(FEATURES))), np.array([float(next(iter(counts)))]))
            if sum(counts.values()) > bound:
                return fit_all(vectors, counts)
            # Labels of documents that aren't there: few rows are left.
            few = sorted(vectors.select("k", "y", "x").collect())
            return fit(np.array([r["x"] for r in few]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in few], float))
        finally:
            drop(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array(list(features(b.column("text"))), pa.list_(pa.float64()))], names=["k", "y", "x"])

    chosen = cut(sample(documents, labels, label, bound, key=key, text=text).select(F.col("k").cast("long"), "y", "text"))
    rows = chosen.mapInArrow(run, "k long, y int, x array<double>").collect()
    drop(chosen)
    rows.sort(key=lambda r: (r["k"], r["y"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], float))


def score(documents: DataFrame, ranker: Ranker, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score, strength)."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(ranker.score(x)), pa.array(ranker.strength(x))], names=[key, "score", "strength"])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, score double, strength double")


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
