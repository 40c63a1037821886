"""op10's search: the same neighbours by either way through the postings, and what it takes of memory and of dense work."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import toxicity as X


def index(n: int = 4000, v: int = 3000, topics: int = 20, each: int = 60) -> tuple[X.Index, np.ndarray]:
    """Examples of topics that lie together: frequent terms, terms of a topic with some 150 examples, and rare ones."""
    r = np.random.default_rng(11)
    dense = np.zeros((n, v))
    topic = np.arange(n) * topics // n
    own = 20 + topic[:, None] * (1000 // topics) + r.integers(0, 1000 // topics, (n, each // 2))
    anywhere = r.integers(1020, v, (n, each // 3))
    for columns, low in ((r.integers(0, 20, (n, each // 6)), 0.1), (own, 0.4), (anywhere, 0.6)):
        np.put_along_axis(dense, columns, low + r.random(columns.shape), 1)
    dense[1000:1040] = dense[1000]
    dense /= np.sqrt((dense**2).sum(1))[:, None]
    term, ex = np.nonzero(dense.T)
    return X.Index(np.arange(v).astype(np.uint64), np.ones(v), np.zeros(1 << 20, bool), r.permutation(n), np.zeros(n), np.ones(n), 0.1, np.searchsorted(term, np.arange(v + 1)), ex.astype(np.int32), dense[ex, term]), dense


@pytest.mark.parametrize("sparse", [1, 8, 10**6])
def test_neighbours_by_picked_and_by_whole_postings(monkeypatch, sparse):
    monkeypatch.setattr(X, "SPARSE", sparse)
    ix, dense = index()
    assert len(ix.blocks().matrix) and len(ix.blocks().peak) > 500 and (ix.blocks().peak_of < 0).sum() > 1000
    queries, left = [], []
    for i in [*range(0, len(dense), 97), 1003]:
        term = np.flatnonzero(dense[i])
        queries += [(term, dense[i][term]), (term[-5:], dense[i][term[-5:]])]
        left += [i, -1]
    for (t, x), skip, (got, cosine) in zip(queries, left, ix.nearest_of(queries, left), strict=True):
        full = dense[:, t] @ x
        if skip >= 0:
            full[skip] = -1
        order = np.lexsort((ix.ids, -np.round(full, 12)))[: X.NEIGHBOURS]
        order = order[full[order] > 0]
        assert np.allclose(cosine, full[order]) and sorted(got[cosine > cosine[-1:] + 1e-9]) == sorted(order[full[order] > full[order[-1:]] + 1e-9])


def test_terms_of_one_example_in_twenty_are_no_rows_of_the_matrix():
    """A row costs every document a product with every example."""
    r = np.random.default_rng(3)
    has = r.random((400, 3000)) < 0.05
    term, ex = np.nonzero(has)
    ix = X.Index(np.arange(400).astype(np.uint64), np.ones(400), np.zeros(1 << 20, bool), np.arange(3000), np.zeros(3000), np.ones(3000), 0.1, np.searchsorted(term, np.arange(401)), ex.astype(np.int32), np.full(len(ex), 0.1))
    assert len(ix.blocks().matrix) < 10


def test_a_process_lets_go_of_the_postings_and_makes_blocks_in_bounded_memory():
    ix, _ = index(n=12000, v=6000)
    postings = len(ix.post_example)
    tracemalloc.start()
    try:
        blocks = ix.searchable().blocks()
        peak = tracemalloc.get_traced_memory()[1] - blocks.matrix.nbytes
    finally:
        tracemalloc.stop()
    assert peak < 40 * postings
    assert ix.post_example is None and ix.post_weight is None
    own = blocks.own(5)
    assert len(own[0]) and np.isclose((own[1] ** 2).sum(), 1)


def test_a_worker_that_waits_holds_no_index():
    """A machine has more workers than tasks, and tasks take them in turn."""

    class Shared:
        @property
        def value(self):
            self.__dict__.setdefault("_value", index()[0])
            return self._value

    shared = Shared()
    with X._lent(shared) as ix:
        assert ix._blocks is not None and ix.post_weight is None
    assert ix._blocks is None and "_value" not in shared.__dict__
    with X._lent(shared) as again:
        assert len(again.nearest(np.array([3]), np.ones(1))[0])


def test_a_posting_takes_four_bytes_and_neighbours_stay_exact():
    """The search waits for memory. Weights that one step can't tell apart still decide, and none is too small to count."""
    n = 6000
    term, weight = np.repeat(np.arange(20), n // 20), np.full(n, 0.5) + np.arange(n) * 1e-9
    weight[term == 7] *= 1e-9
    ix = X.Index(np.arange(20).astype(np.uint64), np.ones(20), np.zeros(1 << 20, bool), np.arange(n), np.zeros(n), np.ones(n), 0.1, np.arange(21) * (n // 20), np.arange(n, dtype=np.int32), weight)
    assert ix.blocks().posts.itemsize == 4
    for t in (3, 7):
        ex, cosine = ix.nearest(np.array([t]), np.ones(1))
        own = np.flatnonzero(term == t)[::-1][: X.NEIGHBOURS]
        assert ex.tolist() == own.tolist() and np.array_equal(cosine, weight[own])


def test_more_examples_than_two_bytes_number():
    n, each = 80000, 400
    r = np.random.default_rng(4)
    weight = 0.1 + r.random(n)
    ix = X.Index(np.arange(n // each).astype(np.uint64), np.ones(n // each), np.zeros(1 << 20, bool), np.arange(n), np.zeros(n), np.ones(n), 0.1, np.arange(0, n + 1, each), r.permutation(n).astype(np.int32), weight)
    for t in range(n // each):
        own = slice(t * each, (t + 1) * each)
        ix.post_example[own] = np.sort(ix.post_example[own])
    ex, cosine = ix.nearest(np.array([150]), np.ones(1))
    best = np.argsort(-weight[60000:60400])[: X.NEIGHBOURS] + 60000
    assert ex.tolist() == ix.post_example[best].tolist() and np.array_equal(cosine, weight[best])


def test_documents_are_searched_in_whole_groups(monkeypatch):
    """The dense product of a small group costs about half as much again a document; a chunk of texts is not a group."""
    ix, _ = index(n=2000)
    sizes, whole = [], X.Blocks.nearest
    monkeypatch.setattr(X.Blocks, "nearest", lambda self, queries, *a: sizes.append(len(queries)) or whole(self, queries, *a))
    monkeypatch.setattr(X.Index, "vectors", lambda self, w: ((t, np.array([t % 20]), np.ones(1)) for t in range(w.texts)))
    monkeypatch.setattr("tessera.llm.wordhash.CHUNK_BYTES", 1000)
    rows = [row for row, *_ in ix.judged(pa.array([f"word{i:06d}" for i in range(700)]))]
    assert rows == list(range(700)) and sizes == [X.GROUP] * 5 + [60]


def test_words_are_found_in_buckets_of_the_vocabulary():
    r = np.random.default_rng(6)
    # Many terms share their leading bits, in the first bucket and the last too.
    known = np.unique(np.r_[r.integers(0, 1 << 63, 5000, np.uint64) * 2, np.arange(40, dtype=np.uint64) * 3, np.uint64(2**64 - 1) - np.arange(40, dtype=np.uint64) * 3])
    asked = np.r_[known, known + np.uint64(1), np.arange(130, dtype=np.uint64), r.integers(0, 1 << 63, 999, np.uint64)]
    ix = X.Index(known, np.ones(len(known)), X._filter(known), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0.1)
    at, term = ix.find(asked)
    assert at.tolist() == np.flatnonzero(np.isin(asked, known)).tolist() and np.array_equal(known[term], asked[at])
