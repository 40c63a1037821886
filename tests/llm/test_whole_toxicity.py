"""op10 learns from a sample that doesn't shrink, and shows all its evidence."""

from __future__ import annotations

import collections
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import toxicity as X
from tessera.llm.queries import op10_toxicity
from tessera.llm.wordhash import ALNUM, words

from llm_cases import SCHEMA, make

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def many(spark):
    """3000 documents, two thirds of them toxic."""
    texts = [f"plain words number{i} " + ("vile scumbag" if i % 3 else "kind friend") for i in range(3000)]
    docs = spark.createDataFrame(make(texts), SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i in range(3000)], "doc_id long, quality int, toxic int")


def test_all_learnable_toxic_rows_up_to_4000(many):
    learnable = sum(i % 3 > 0 and zlib.crc32(str(i).encode()) % 3 != 1 for i in range(3000))
    assert X.SAMPLE >= 4000 and learnable < 4000
    small, whole = X.build(*many, bound=700), X.build(*many, bound=X.SAMPLE)
    assert small.label.sum() == 700 and whole.label.sum() == learnable


def test_every_voting_neighbour_is_shown(many):
    docs, labels = many
    ix = X.build(docs, labels)
    place = {int(i): n for n, i in enumerate(ix.ids)}
    rows = [r for r in X.toxic_scores(docs, labels).limit(200).collect() if r["neighbours"]]
    assert max(len(r["neighbours"]) for r in rows) == X.NEIGHBOURS
    for r in rows:
        vote = ix.vote(np.array([place[n["id"]] for n in r["neighbours"]]), np.array([n["cosine"] for n in r["neighbours"]]))
        assert abs(ix.score(vote) - r["score"]) < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_the_query_has_the_evidence(spark):
    assert "neighbours" in op10_toxicity(spark, SF).columns


def test_idf_counts_every_document(many, spark):
    docs, labels = many
    more = docs.unionByName(spark.createDataFrame(make(["Vile weather"] * 500 + [None, "nothing"], start=10_000), SCHEMA))
    ix = X.build(more, labels)
    (w,) = words(pa.array(["vile"]), ALNUM, lower=True)
    _, i = ix.find(w.hashes())
    assert len(i) == 1 and np.isclose(ix.idf[i[0]], np.log((1 + 3502) / (1 + 2000 + 500)) + 1)


def test_every_term_of_the_sample_is_in_the_index(many):
    """Terms of one example alone and of the clean class too; a vector takes in the whole text."""
    docs, labels = many
    ix = X.build(docs, labels)
    learnable = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(ix.ids) == len(learnable) and len(ix.vocabulary) == 6 + len(learnable)
    (w,) = words(pa.array([f"plain words number{learnable[0]} kind friend nobody knows these"]), ALNUM, lower=True)
    ((_, term, x),) = ix.vectors(w)
    assert len(term) == 5 and np.isclose((x**2).sum(), 1) and (ix.relevance >= 1).all()


def test_ids_dont_move_scores(spark):
    """Ties of cosine go by text: the same texts under other ids of the same sample get the same scores."""
    texts = [f"same start {'vile' if i % 2 else 'fine'} w{i % 40}" for i in range(240)] + ["same start", "vile", ""]
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1][: len(texts)]
    found = []
    for own in (ids, ids[::-1]):
        docs = spark.createDataFrame([(i, t) for i, t in zip(own, texts, strict=True)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(own) if n < 240], "doc_id long, toxic int")
        scores = {r["doc_id"]: r["score"] for r in X.toxic_scores(docs, labels).collect()}
        found.append([scores[i] for i in own])
    assert np.allclose(*found, atol=1e-9)


def test_keys_must_be_whole(spark):
    docs = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole number"):
        X.build(docs, spark.createDataFrame([], "doc_id string, quality int, toxic int"))


def test_no_bound_on_the_vocabulary(spark):
    bad = " ".join(f"v{i}" for i in range(1500))
    docs = spark.createDataFrame(make([bad if i % 2 else "fine words" for i in range(90)]), SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(90)], "doc_id long, quality int, toxic int")
    assert len(X.build(docs, labels).vocabulary) >= 1500


def test_block_max_search_over_many_blocks():
    """Against dense cosines: random sparse vectors with frequent and rare terms, ties, equal examples, and one example left out."""
    r = np.random.default_rng(5)
    v, n = 400, 1500
    chance = np.where(np.arange(v) < 12, 0.5, 0.01)
    dense = r.random((n, v)) * (r.random((n, v)) < chance)
    dense[np.arange(n), r.integers(0, v, n)] += 0.5
    dense[700:760] = dense[700]
    dense /= np.sqrt((dense**2).sum(1))[:, None]
    term, ex = np.nonzero(dense.T)
    ids = r.permutation(n)
    ix = X.Index(np.arange(v).astype(np.uint64), np.ones(v), np.zeros(1 << 20, bool), ids, np.zeros(n), np.ones(n), 0.1, np.searchsorted(term, np.arange(v + 1)), ex, dense[ex, term])
    queries = [(np.flatnonzero(dense[i]), dense[i][dense[i] > 0]) for i in [*range(0, n, 11), 703]]
    queries += [(np.array([t]), np.ones(1)) for t in (0, 5, 20, 399)] + [(np.zeros(0, np.int64), np.zeros(0))]
    left = [*range(0, n, 11), 703, -1, -1, -1, -1, -1]
    for (t, x), skip, (got, cosine) in zip(queries, left, ix.nearest_of(queries, left), strict=True):
        full = dense[:, t] @ x
        if skip >= 0:
            full[skip] = -1
        order = np.lexsort((ids, -np.round(full, 12)))
        order = order[full[order] > 0][: X.NEIGHBOURS]
        assert np.allclose(cosine, full[order]) and sorted(got[cosine > cosine[-1:] + 1e-9]) == sorted(order[full[order] > full[order[-1:]] + 1e-9])


def brute_scores(rows, labels):
    """What op10 does, in plain Python over dictionaries of words."""
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def words_of(text):
        return collections.Counter(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(lower)))

    bags = {i: words_of(t) for i, t in rows}
    learn = {i: y for i, y in labels if i in bags and y in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1}
    n1, n0 = sum(learn.values()), len(learn) - sum(learn.values())
    seen = {y: collections.Counter(t for i, own in learn.items() if own == y for t in bags[i]) for y in (0, 1)}

    def ratio(t):
        a, b = seen[1][t], seen[0][t]
        n = n1 + n0
        return 2 * sum(x * math.log(x * n / (r * c)) for x, r, c in ((a, a + b, n1), (b, a + b, n0), (n1 - a, n - a - b, n1), (n0 - b, n - a - b, n0)) if x)

    terms = {t: 1 + max(0.0, ratio(t)) for t in seen[0] | seen[1]}
    df = collections.Counter(t for bag in bags.values() for t in bag if t in terms)

    def vector(bag):
        x = {t: (1 + math.log(n)) * (math.log((1 + len(bags)) / (1 + df[t])) + 1) * terms[t] for t, n in bag.items() if t in terms}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / norm for t, v in x.items()}

    vectors = {i: vector(b) for i, b in bags.items()}
    examples = {i: vectors[i] for i in learn if vectors[i]}
    prior = n1 / (n1 + n0)
    texts = dict(rows)
    tie = {i: (np.uint64(xxhash.xxh64(texts[i].encode(), seed=42).intdigest()).astype(np.int64), learn[i], i) for i in examples}

    def vote(x, skip=None):
        near = sorted((-round(sum(v * e.get(t, 0) for t, v in x.items()), 12), tie[i], i) for i, e in examples.items() if i != skip)
        near = [(-s, i) for s, _, i in near if s < 0][: X.NEIGHBOURS]
        return (sum(s * learn[i] for s, i in near) + X.PRIOR * prior) / (sum(s for s, _ in near) + X.PRIOR)

    own = [(vote(x, skip=i), learn[i]) for i, x in examples.items()]
    a, b = X._fit_slope(np.array([v for v, _ in own]), np.array([float(y) for _, y in own]), np.ones(len(own)))
    return {i: 1 / (1 + math.exp(-(a * math.log(v / (1 - v)) + b))) for i, v in ((i, min(max(vote(x), 1e-6), 1 - 1e-6)) for i, x in vectors.items())}


@pytest.mark.skipif(not os.path.isdir(SF.replace("0.001", "0.01")), reason="the driver's tables aren't here")
def test_query_against_brute_force(spark):
    at = SF.replace("0.001", "0.01")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{at}/labels.parquet").collect()]
    expected = brute_scores(rows, labels)
    got = {r["doc_id"]: r for r in op10_toxicity(spark, at).collect()}
    assert set(got) == set(expected) and all(abs(got[i]["score"] - s) < 1e-6 and got[i]["predicted"] == (s >= 0.7) for i, s in expected.items())
    assert max(expected.values()) > 0.9
