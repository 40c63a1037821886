"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are the lower-cased words of a text, all of them. Learning, from a bounded sample of labelled
rows (SAMPLE toxic ones and OTHERS times as many others):

1. Spark counts, for every term of the sample, the examples of each class that have it. All of them
   are the vocabulary. A term's relevance is 1 and the log-likelihood ratio of its presence against
   the class, so a term that tells nothing keeps its plain TF-IDF weight.
2. Spark counts the documents, labelled or not, that have each of these terms. Each example becomes a
   vector (1 + ln tf) * idf * relevance of length one, with the smoothed idf of these counts.
3. The vectors go into an inverted index: postings by term, in blocks of BLOCK examples that lie
   near each other. Terms of one in FREQUENT examples or more are in as good as every block and can't
   rule one out; their weights are rows of a matrix. Terms of fewer than RARE examples are always read.
   The others have the largest weight of every (term, block).

GROUP documents are searched at a time. The matrix and the rare terms give their exact partial cosines
with all examples. The k-th largest of the blocks' best partial cosines is a lower bound of the k-th
cosine; a block's upper bound is its best partial cosine and, for the other terms, the document's weights
times the block's largest weights. Where at most one in SPARSE blocks has an upper bound that reaches the
lower one, the other terms' postings are read in these alone; else all of them are, for to pick them
costs more than to read them. Weights in postings are rounded to steps, none to 0. What could be among the
k best, by all that steps and single precision can be off, is scored again in full precision, so the
neighbours are those of a full scan. The votes of the neighbours, each weighted by cosine and by how many labelled rows it stands
for, and a prior of PRIOR votes give the score; two coefficients fitted on the examples' own
leave-one-out votes, which the executors work out, make it a probability. A document whose words no
example has has no neighbour and gets the prior's score.

Defined cases: null and empty texts have no terms; repeated rows get equal scores; ties of cosine go by
the examples' texts (least hash), then label, so ids don't move a score; keys that aren't whole numbers
are refused; without labels, or with one class alone, every score is that class's share (0 without
labels); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, sample
from tessera.llm.tables import cut, drop, small_batches, whole_key
from tessera.llm.wordhash import ALNUM, U, Words, release, words

SAMPLE = 4000
OTHERS = 4
BLOCK = 128
#: Terms that one of so many examples has, or more, are rows of the matrix.
FREQUENT = 16
#: Terms of fewer examples have no largest weights by block.
RARE = 64
#: Postings are picked by block if no more than one in so many blocks is of use.
SPARSE = 8
#: After a query for which picking didn't pay, so many are searched before it is tried again.
REST = 31
#: Examples whose own votes are one task's.
VOTES = 2048
#: Index arrays are put in order in so many parts, which bounds what that takes beside them.
PARTS = 16
#: Documents that are searched at a time.
GROUP = 128
#: Documents, or terms of them, that are searched in a row: taking words from texts in between drives the index out of the processor's cache.
POOL, POOL_TERMS = 1024, 1 << 19
#: More than single-precision sums can be off.
SLACK = 1e-4
NEIGHBOURS = 25
PRIOR = 0.5


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic examples, other examples) of a partition of the sample."""
    for b in batches:
        y = b.column("y").to_numpy()
        for w in words(b.column("text"), ALNUM, lower=True):
            text = w.text_of() + w.first
            if not len(text):
                continue
            pair = np.unique(np.rec.fromarrays([w.hashes(), text], names="h,t"))
            key, at, inside = np.unique(pair["h"], return_index=True, return_inverse=True)
            pos = np.bincount(inside, weights=y[pair["t"]], minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(pos), pa.array(np.bincount(inside, minlength=len(key)) - pos)], names=["term", "pos", "neg"])


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of each range, one after the other."""
    some = size > 0
    low, size = low[some], size[some]
    if not len(low):
        return low
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(low - (ends - size), size)


#: A term of an example, by rank, and its weight.
OWN = np.dtype([("rank", np.int32), ("weight", np.float64)])


_UNCHECKED = pc.TakeOptions(boundscheck=False)


def _lists(start: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of `data`, the i-th from start[i] to start[i + 1], as bytes: Arrow's take puts some of them together."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(start.astype(np.int64) * data.itemsize), pa.py_buffer(data)])


def _together(lists: pa.LargeBinaryArray, which: np.ndarray, kind: np.dtype | type, many: int) -> np.ndarray:
    """The `many` entries of these runs, one after the other."""
    if not many:
        return np.zeros(0, kind)
    which = pa.Array.from_buffers(pa.int64(), len(which), [None, pa.py_buffer(which)])
    return np.frombuffer(pc.call_function("take", [lists, which], _UNCHECKED).buffers()[2], kind, many)


def _in_order(key: np.ndarray, size: int, then: np.ndarray | None = None, parts: int = PARTS) -> Iterator[np.ndarray]:
    """Places in the order of `key` (whole numbers below `size`), then of `then` or as they lie, a range of keys at a time."""
    step = max(1, -(-size // parts))
    for low in range(0, size, step):
        at = np.flatnonzero((key >= low) & (key < low + step))
        own = key[at] - low
        # Keys of 16 bits are sorted by radix.
        own = own.astype(np.uint16) if step <= 1 << 16 else own
        yield at[np.argsort(own, kind="stable") if then is None else np.lexsort((then[at], own))]


#: The leading bits of a hash that a filter tells known terms by.
FILTER_BITS = 22
#: The leading bits that put the vocabulary into buckets.
BUCKET_BITS = 20


def _filter(vocabulary: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[(vocabulary >> U(64 - FILTER_BITS)).astype(np.int64)] = True
    return bits


@dataclass
class Index:
    vocabulary: np.ndarray  # sorted hashes
    term_weight: np.ndarray  # idf * relevance
    bits: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    prior: float
    start: np.ndarray | None = None  # of each term's postings
    post_example: np.ndarray | None = None
    post_weight: np.ndarray | None = None
    slope: tuple[float, float] = (1.0, 0.0)
    content: np.ndarray | None = None  # hashes of the examples' texts
    idf: np.ndarray | None = None
    relevance: np.ndarray | None = None
    _first: np.ndarray | None = None
    _blocks: Blocks | None = None
    _shared: Broadcast | None = None

    def __getstate__(self) -> dict:
        """Without what each process makes for itself, and what the driver alone asks for."""
        return self.__dict__ | {"_first": None, "_blocks": None, "_shared": None, "idf": None, "relevance": None}

    def shared(self, spark: SparkSession) -> Broadcast:
        """One broadcast for the votes of the examples and all scores; the slope, which comes in between, goes by itself."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self)
        return self._shared

    def blocks(self) -> Blocks:
        if self._blocks is None:
            self._blocks = Blocks.of(self)
        return self._blocks

    def searchable(self) -> Index:
        """The index as a process needs it that only searches: without the postings that the blocks are made of."""
        if self._blocks is None and len(self.ids):
            self._blocks = Blocks.of(self, let_go=True)
            release()
        return self

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are in the vocabulary, and their terms."""
        at = np.flatnonzero(self.bits[(h >> U(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        # Few terms share their leading bits, and these lie together.
        h, first = h[at], self.first()
        lead = (h >> U(64 - BUCKET_BITS)).astype(np.int64)
        i, end = first[lead].astype(np.int64), first[lead + 1]
        left = np.flatnonzero(i < end)
        while len(left := left[self.vocabulary[i[left]] < h[left]]):
            i[left] += 1
            left = left[i[left] < end[left]]
        own = i < end
        own[own] = self.vocabulary[i[own]] == h[own]
        return at[own], i[own]

    def first(self) -> np.ndarray:
        """The first term of each bucket of hashes."""
        if self._first is None:
            lead = (self.vocabulary >> U(64 - BUCKET_BITS)).astype(np.int64)
            self._first = np.r_[0, np.cumsum(np.bincount(lead, minlength=1 << BUCKET_BITS))].astype(np.int32)
        return self._first

    @property
    def term_bits(self) -> int:
        return len(self.vocabulary).bit_length()

    def pairs(self, w: Words, at: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The text of each word found, and its term in the last term_bits."""
        return (w.text_of()[at] << self.term_bits) | i

    def vectors(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text within the chunk, terms, weights) of texts that have a term."""
        at, i = self.find(w.hashes())
        if not len(at):
            return
        pair, tf = np.unique(self.pairs(w, at, i), return_counts=True)
        texts, term = pair >> self.term_bits, pair & ((1 << self.term_bits) - 1)
        x = (1 + np.log(tf)) * self.term_weight[term]
        for a, b in zip(c := np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]]), [*c[1:], len(texts)], strict=True):
            yield int(texts[a]), term[a:b], x[a:b] / np.sqrt((x[a:b] ** 2).sum())

    def nearest(self, term: np.ndarray, x: np.ndarray, skip: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above 0, and the cosines."""
        return self.nearest_of([(term, x)], [skip], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None, k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        blocks = self.blocks()
        ties = (self.ids, self.label, self.ids if self.content is None else self.content)
        out: list = []
        for at in range(0, len(queries), GROUP):
            out += blocks.nearest(queries[at : at + GROUP], skip[at : at + GROUP] if skip else None, ties, k)
        return out

    def judged(self, column: pa.Array) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        """(row, score, neighbours, cosines) of the texts that have a term."""
        found: list = []
        for w in words(column, ALNUM, lower=True):
            found += [(w.first + t, term, x) for t, term, x in self.vectors(w)]
            if len(found) >= POOL or sum(len(term) for _, term, _ in found) >= POOL_TERMS:
                # Whole groups, for the dense product costs a small one more a document.
                full = len(found) // GROUP * GROUP
                yield from self._judged(found[:full])
                found = found[full:]
        yield from self._judged(found)

    def _judged(self, found: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        for (row, _, _), (ex, s) in zip(found, self.nearest_of([(term, x) for _, term, x in found]), strict=True):
            yield row, self.score(self.vote(ex, s)), ex, s

    def vote(self, ex: np.ndarray, s: np.ndarray) -> float:
        w = s * self.weight[ex]
        return float((w @ self.label[ex] + PRIOR * self.prior) / (w.sum() + PRIOR))

    def score(self, vote: float) -> float:
        a, b = self.slope
        v = min(max(vote, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-(a * np.log(v / (1 - v)) + b))))


@contextmanager
def _lent(shared: Broadcast) -> Iterator[Index]:
    """The index for one task. Workers stay after their tasks, tasks take them in turn, and a machine may have twice as
    many as it runs tasks at once: those that wait must not hold an index each. The next task reads the broadcast's file again."""
    ix: Index = shared.value.searchable()
    try:
        yield ix
    finally:
        ix._blocks = None
        shared.__dict__.pop("_value", None)
        release()


@dataclass
class Blocks:
    """The index as the search reads it, made in each process from the postings."""

    row_of: np.ndarray  # of each term in the matrix, or -1
    matrix: np.ndarray  # terms x examples, padded to whole blocks
    blocks: int
    low: np.ndarray  # of each other term's postings
    posts: np.ndarray  # one number each, for the search waits for memory: the lower half is the example, the upper the weight in steps
    step: float  # of the postings' weights
    peak_of: np.ndarray  # each term's row in the next two, or -1
    peak: np.ndarray  # the largest weight in each block
    parts: np.ndarray  # where each block's postings start
    example: np.ndarray  # where each example's own terms start
    rank: np.ndarray  # of each term by its examples, so that the places of frequent terms lie together
    owned: np.ndarray  # the examples' terms
    place: np.ndarray  # zeros, for the places of one query's terms by rank
    rest: int = 0  # queries until picking is tried again

    def __post_init__(self) -> None:
        self.post_lists = _lists(self.low, self.posts)
        self.own_lists = _lists(self.example, self.owned)

    @classmethod
    def of(cls, ix: Index, *, let_go: bool = False) -> Blocks:
        """With `let_go` the index loses its postings as soon as they aren't needed."""
        n, v = len(ix.ids), len(ix.vocabulary)
        blocks, size = -(-n // BLOCK), np.diff(ix.start)
        rank = np.empty(v, np.int32)
        rank[np.argsort(-size, kind="stable")] = np.arange(v)
        example = np.r_[0, np.cumsum(np.bincount(ix.post_example, minlength=n))]
        of_posting, at = np.repeat(rank, size), 0
        owned = np.empty(len(of_posting), OWN)
        for own in _in_order(ix.post_example, n, parts=4):
            owned["rank"][at : at + len(own)], owned["weight"][at : at + len(own)] = of_posting[own], ix.post_weight[own]
            at += len(own)
        del of_posting
        post_example, post_weight = ix.post_example.astype(np.min_scalar_type(n)), ix.post_weight.astype(np.float32)
        if let_go:
            ix.post_example = ix.post_weight = None
        heavy = np.flatnonzero(size >= max(1, n // FREQUENT))
        row_of = np.full(v, -1, np.int32)
        row_of[heavy] = np.arange(len(heavy))
        matrix = np.zeros((len(heavy), blocks * BLOCK), np.float32)
        for row, t in zip(matrix, heavy, strict=True):
            own = slice(ix.start[t], ix.start[t + 1])
            row[post_example[own]] = post_weight[own]
        light = np.where(row_of < 0, size, 0)
        kept, low = np.repeat(row_of < 0, size), np.r_[0, np.cumsum(light)]
        weight = post_weight[kept]
        step = float(weight.max(initial=0)) / 0xFFFF or 1.0
        weight /= np.float32(step)
        posts = np.clip(np.rint(weight, out=weight), 1, 0xFFFF).astype(np.uint32 if n <= 1 << 16 else np.uint64)
        posts <<= posts.itemsize * 4
        posts |= post_example[kept]
        del post_example, post_weight, weight, kept
        half, lower = posts.itemsize * 4, (1 << posts.itemsize * 4) - 1
        some = np.flatnonzero(light >= RARE)
        peak_of = np.full(v, -1, np.int32)
        peak_of[some] = np.arange(len(some))
        peak, parts = np.zeros((len(some), blocks), np.float32), np.empty((len(some), blocks + 1), np.int32)
        for at in np.array_split(some, PARTS):
            # Postings lie by (term, example), so those of a block lie together.
            post, row = _ranges(low[at], light[at]), peak_of[at]
            place = np.repeat(np.arange(len(at)), light[at]) * blocks + (posts[post] & lower).astype(np.int64) // BLOCK
            first = np.flatnonzero(np.diff(place, prepend=-1))
            if len(first):
                peak[row[0] : row[-1] + 1].ravel()[place[first]] = np.maximum.reduceat(posts[post] >> half, first) * np.float32(step)
            many = np.bincount(place, minlength=len(at) * blocks).reshape(len(at), blocks)
            parts[row] = low[at][:, None] + np.c_[np.zeros(len(at), np.int64), np.cumsum(many, axis=1)]
        return cls(row_of, matrix, blocks, low, posts, step, peak_of, peak, parts, example, rank, owned, np.zeros(v, np.uint16))

    def own(self, example: int) -> tuple[np.ndarray, np.ndarray]:
        """An example's terms and weights."""
        at = slice(self.example[example], self.example[example + 1])
        return self.term_of[self.owned["rank"][at]], self.owned["weight"][at]

    @cached_property
    def term_of(self) -> np.ndarray:
        """The term of each rank."""
        return np.argsort(self.rank)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None, ties: tuple[np.ndarray, ...], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        weights = np.zeros((len(queries), len(self.matrix)), np.float32)
        for i, (term, x) in enumerate(queries):
            row = self.row_of[term]
            weights[i, row[row >= 0]] = x[row >= 0]
        # The same place each time: to get and to clear a new one costs as much as a fifth of the product.
        partial = np.matmul(weights, self.matrix, out=self.partial[: len(queries)])
        for i, own in enumerate(skip or ()):
            if own >= 0:
                partial[i, own] = -2
        return [self._of_one(term, x, partial[i], ties, k) for i, (term, x) in enumerate(queries)]

    @cached_property
    def partial(self) -> np.ndarray:
        return np.empty((GROUP, self.matrix.shape[1]), np.float32)

    def _add(self, s: np.ndarray, posts: np.ndarray, x: np.ndarray, many: np.ndarray) -> np.ndarray:
        """`s` and what the postings add to it, `many` of each weight of `x`."""
        if not len(posts):
            return s
        half = posts.itemsize * 4
        weight = (posts >> half).astype(np.float32)
        weight *= np.repeat((x * self.step).astype(np.float32), many)
        got = np.bincount((posts & ((1 << half) - 1)).astype(np.int64), weights=weight, minlength=len(s))
        got += s
        return got

    def _whole(self, s: np.ndarray, term: np.ndarray, x: np.ndarray, many: np.ndarray) -> np.ndarray:
        """`s` and what all postings of the terms add to it."""
        return self._add(s, _together(self.post_lists, term, self.posts.dtype, int(many.sum())), x, many)

    def _least(self, best: np.ndarray, k: int) -> float:
        """A lower bound of the k-th cosine, of the best ones of disjoint sets of examples."""
        return float(np.partition(best, len(best) - k)[len(best) - k]) if len(best) > k else 0.0

    def _picked(self, s: np.ndarray, term: np.ndarray, x: np.ndarray, many: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, float]:
        """All cosines, or those in the blocks that can hold the k best and partial ones elsewhere, which are too small; and a lower bound of the k-th."""
        row = self.peak_of[term]
        rare = row < 0
        s = self._whole(s, term[rare], x[rare], many[rare])
        term, x, many, row = term[~rare], x[~rare], many[~rare], row[~rare]
        best = s.reshape(self.blocks, BLOCK).max(1)
        least = self._least(best, k)
        bound = best + x.astype(np.float32) @ self.peak[row]
        live = np.flatnonzero((bound >= least - slack) & (bound > 0))
        if SPARSE * len(live) > self.blocks:
            self.rest = REST
            return self._whole(s, term, x, many), least
        low = self.parts[row[:, None], live]
        many = (self.parts[row[:, None], live + 1] - low).ravel()
        return self._add(s, self.posts[_ranges(low.ravel(), many)], np.repeat(x, len(live)), many), least

    def _of_one(self, term: np.ndarray, x: np.ndarray, partial: np.ndarray, ties: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, np.ndarray]:
        many = self.low[term + 1] - self.low[term]
        some = many > 0
        light = term[some], x[some], many[some]
        # A weight is off by a step at most, and two cosines are compared.
        slack = SLACK + 2 * self.step * float(light[1].sum())
        if self.rest:
            self.rest -= 1
            s, least = self._whole(partial, *light), 0.0
        else:
            s, least = self._picked(partial, *light, k, slack)
        # Sets of examples that lie far from each other: those that lie together are alike, and a set yields its best alone.
        least = max(least, self._least(s.reshape(BLOCK, self.blocks).max(0), k))
        ex = np.flatnonzero(s > max(least - slack, 0.0))
        near = s[ex]
        if len(ex) > k:
            reach = near >= float(np.partition(near, len(near) - k)[len(near) - k]) - slack
            ex = ex[reach]
        if not len(ex):
            return ex, np.zeros(0)
        many, rank = self.example[ex + 1] - self.example[ex], self.rank[term]
        owned = _together(self.own_lists, ex, OWN, int(many.sum()))
        # Two small tables are looked up faster than one of all terms' weights.
        place = self.place if len(term) < 1 << 16 else np.zeros(len(self.place), np.uint32)
        place[rank] = np.arange(1, len(term) + 1)
        product = np.r_[0.0, x].take(place.take(owned["rank"]))
        product *= owned["weight"]
        s = np.add.reduceat(product, np.cumsum(many) - many)
        place[rank] = 0
        keep = np.lexsort((*(t[ex] for t in ties), -s))[:k]
        return ex[keep], s[keep]


def _fit_slope(vote: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Two logistic coefficients, by Newton steps with a small ridge about (1, 0)."""
    v = np.clip(vote, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], 1)
    target = np.array([1.0, 0.0])
    c = target.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ c))
        g = x.T @ (weight * (p - y)) + (c - target)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(h, g)
        c = c - step
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


def document_counts(documents: DataFrame, index: Index, *, text: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents, and how many of them have each term of the vocabulary."""
    shared = small_batches(documents).sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = shared.value
        v, docs = len(ix.vocabulary), 0
        have = np.zeros(v, np.int64)
        for b in batches:
            docs += b.num_rows
            for w in words(b.column("text"), ALNUM, lower=True):
                at, i = ix.find(w.hashes())
                if len(at):
                    np.add.at(have, np.unique(ix.pairs(w, at, i)) & ((1 << ix.term_bits) - 1), 1)
        # The place after the last term counts the documents.
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, v]), pa.array(np.r_[have[at], docs])], names=["i", "n"])

    counted = documents.select(F.col(text).alias("text")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(index.vocabulary) + 1)
    out[counted["i"].to_numpy()] = counted["n"].to_numpy()
    shared.destroy()
    return int(out[-1]), out[:-1]


def own_votes(spark: SparkSession, index: Index) -> np.ndarray:
    """Each example's vote by the others, worked out by the executors."""
    shared = index.shared(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _lent(shared) as ix:
            for b in batches:
                own = b.column("id").to_pylist()
                found = ix.nearest_of([ix.blocks().own(i) for i in own], own)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([ix.vote(*f) for f in found], pa.float64())], names=["id", "vote"])

    got = spark.range(0, len(index.ids), 1, -(-len(index.ids) // VOTES)).mapInArrow(run, "id long, vote double").toArrow()
    out = np.zeros(len(index.ids))
    out[got["id"].to_numpy()] = got["vote"].to_numpy()
    return out


def build(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", bound: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Index:
    """The index, on the driver: its size is bounded by the sample's texts."""
    whole_key(documents, key)
    spark = documents.sparkSession
    # Bounded by the sample, and read four times.
    chosen = cut(sample(documents, labels, label, bound, others=OTHERS * bound, key=key, text=text))
    classes = {r["y"]: (r["n"], r["w"]) for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    n1, n0 = classes.get(1, (0, 0.0)), classes.get(0, (0, 0.0))
    prior = n1[1] / (n1[1] + n0[1]) if n1[1] + n0[1] else 0.0
    none = np.zeros(0)
    index = Index(np.zeros(0, U), none, _filter(np.zeros(0, U)), np.zeros(0, np.int64), none, none, prior)
    if not n1[0] or not n0[0]:
        return index
    counts = chosen.mapInArrow(_term_counts, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # The log-likelihood ratio of the term's presence against the class.
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    c, d, n = n1[0] - a, n0[0] - b, float(n1[0] + n0[0])

    def part(seen, row, column):
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    ratio = 2 * (part(a, a + b, F.lit(float(n1[0]))) + part(b, a + b, F.lit(float(n0[0]))) + part(c, c + d, F.lit(float(n1[0]))) + part(d, c + d, F.lit(float(n0[0]))))
    # As many rows as the sample has terms.
    known = counts.select("term", (F.greatest(ratio, F.lit(0.0)) + 1).alias("relevance")).toArrow()
    if not known.num_rows:
        return index
    term = known["term"].to_numpy().view(U)
    at = np.argsort(term)
    index.vocabulary, index.relevance, index.bits = term[at], known["relevance"].to_numpy()[at], _filter(term)
    del known, term, at
    n, have = document_counts(documents, index, text=text)
    index.idf = np.log((1 + n) / (1 + have)) + 1
    index.term_weight = index.idf * index.relevance
    shared = spark.sparkContext.broadcast(index)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for w in words(r.column("text"), ALNUM, lower=True):
                for t, term, x in shared.value.vectors(w):
                    yield pa.RecordBatch.from_arrays([r.column(n).slice(w.first + t, 1) for n in ("k", "y", "weight", "content")] + [pa.array([term.astype(np.int32)], pa.list_(pa.int32())), pa.array([x], pa.list_(pa.float64()))], names=["k", "y", "weight", "content", "term", "x"])

    rows = chosen.select(F.col("k").cast("long"), "y", "weight", F.xxhash64("text").alias("content"), "text").mapInArrow(extract, "k long, y int, weight double, content long, term array<int>, x array<double>").toArrow()
    drop(chosen)
    shared.destroy()
    many = np.concatenate([np.array(c.value_lengths()) for c in rows["term"].chunks])
    term, x = (np.concatenate([c.flatten().to_numpy() for c in rows[n].chunks]) for n in ("term", "x"))
    ids, label_of, weight, content = (rows[n].to_numpy() for n in ("k", "y", "weight", "content"))
    # The driver holds the postings once, and once more while they are put in order.
    del rows
    release()
    # Examples with the same most frequent and the same leading term lie together, so that a block's largest weights are few.
    cuts = np.r_[0, np.cumsum(many)]
    lead, common = np.array([(term[a:b][np.argmax(x[a:b])], term[a:b][np.argmax(have[term[a:b]])]) for a, b in zip(cuts, cuts[1:], strict=False)]).T
    order = np.lexsort((ids, label_of, content, lead, common))
    index.ids, index.label, index.weight, index.content = ids[order], label_of[order].astype(float), weight[order], content[order]
    place = np.empty(len(many), np.int32)
    place[order] = np.arange(len(many))
    ex = np.repeat(place, many)
    index.start = np.r_[0, np.cumsum(np.bincount(term, minlength=len(index.vocabulary)))]
    index.post_example, index.post_weight, at = np.empty(len(ex), np.int32), np.empty(len(ex)), 0
    for own in _in_order(term, len(index.vocabulary), ex):
        index.post_example[at : at + len(own)], index.post_weight[at : at + len(own)] = ex[own], x[own]
        at += len(own)
    del term, ex, x
    pa.default_memory_pool().release_unused()
    index.slope = _fit_slope(own_votes(spark, index), index.label, index.weight)
    return index


def score(documents: DataFrame, index: Index, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score, neighbours): neighbours is the evidence, all that vote, nearest first, as (id, label, cosine)."""
    shared, slope = index.shared(small_batches(documents).sparkSession), index.slope
    kind = documents.schema[key].dataType.simpleString()
    near = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _lent(shared) as ix:
            ix.slope = slope
            base = ix.score(ix.prior) if len(ix.ids) else ix.prior
            for b in batches:
                out, many, seen = np.full(b.num_rows, base), np.zeros(b.num_rows + 1, np.int32), []
                if len(ix.ids):
                    # Rows come in order.
                    for at, score, ex, s in ix.judged(b.column("text")):
                        out[at], many[at + 1] = score, len(ex)
                        seen.append((ex, s))
                ex, s = (np.concatenate(c) for c in zip(*seen, strict=True)) if seen else (np.zeros(0, np.int64), np.zeros(0))
                flat = pa.StructArray.from_arrays([pa.array(ix.ids[ex]), pa.array(ix.label[ex].astype(np.int32)), pa.array(s)], fields=list(near.value_type))
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out), pa.ListArray.from_arrays(np.cumsum(many, dtype=np.int32), flat, type=near)], names=[key, "score", "neighbours"])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, score double, neighbours array<struct<id:long,label:int,cosine:double>>")


def without_toxic(documents: DataFrame, index: Index, *, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of `documents`, all columns as they are, whose score is below the threshold. Rows aren't moved."""
    shared, slope = index.shared(small_batches(documents).sparkSession), index.slope
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _lent(shared) as ix:
            ix.slope = slope
            base = ix.score(ix.prior) if len(ix.ids) else ix.prior
            for b in batches:
                keep = np.full(b.num_rows, base < threshold)
                if len(ix.ids):
                    for at, score, _, _ in ix.judged(b.column(place)):
                        keep[at] = score < threshold
                yield b.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)


def toxic_scores(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, neighbours)."""
    scored = score(documents, build(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours")
