from __future__ import annotations

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality as Q
from tessera.llm import toxicity as X
from tessera.llm.wordhash import ALNUM, words

from llm_cases import SCHEMA, make

BAD = ["vile", "scumbag", "wretch", "clownish"]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    texts, toxic, good = [], [], []
    for i in range(600):
        w = [r.choice("lorem ipsum dolor sit amet elit sed magna".split()) + r.choice(["", "s", "um"]) for _ in range(r.randrange(8, 60))]
        t = i % 5 == 0
        g = i % 7 != 0
        if t:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(BAD)
        texts.append(" ".join(x if g else x.upper() + "!!" for x in w))
        toxic.append(int(t))
        good.append(int(g))
    return texts, toxic, good


@pytest.fixture(scope="module")
def tables(spark, corpus):
    texts, toxic, good = corpus
    docs = spark.createDataFrame(make(texts), SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, g, t) for i, (t, g) in enumerate(zip(toxic, good, strict=True))], "doc_id long, quality int, toxic int")
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(tables, corpus, kind):
    docs, labels = tables
    rows = (X.toxic_scores if kind == "toxic" else Q.quality_scores)(docs, labels).collect()
    truth = corpus[1] if kind == "toxic" else corpus[2]
    assert len(rows) == len(truth) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= (0.7 if kind == "toxic" else 0.5)) for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in own) >= 0.97 * len(own)


def test_neighbours_are_those_of_a_full_scan(tables):
    docs, labels = tables
    ix = X.build(docs, labels)
    dense = np.zeros((len(ix.ids), len(ix.vocabulary)))
    for t in range(len(ix.vocabulary)):
        own = slice(ix.start[t], ix.start[t + 1])
        dense[ix.post_example[own], t] = ix.post_weight[own]
    assert np.allclose((dense**2).sum(1), 1) and not any(held(i) for i in ix.ids)
    r = np.random.default_rng(0)
    for _ in range(60):
        term = np.sort(r.choice(len(ix.vocabulary), min(len(ix.vocabulary), r.integers(1, 6)), replace=False))
        x = r.random(len(term))
        x /= np.sqrt((x**2).sum())
        full = dense[:, term] @ x
        order = np.lexsort((ix.ids, -full))
        order = order[full[order] > 0][: X.NEIGHBOURS]
        ex, s = ix.nearest(term, x)
        assert np.allclose(s, full[order]) and np.allclose(full[ex], full[order])


def test_filtering_keeps_columns(tables, corpus):
    docs, labels = tables
    kept = X.without_toxic(docs, X.build(docs, labels))
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum((i in ids) == (not t) for i, t in enumerate(corpus[1])) >= 0.97 * len(corpus[1])


def test_odd_rows_and_labels(spark, mess, tables):
    docs, labels = tables
    for score in (X.toxic_scores, Q.quality_scores):
        assert score(mess, labels).count() == mess.count()
        assert score(mess.limit(0), labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(40)] + [(None, 0, 0), (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in X.toxic_scores(docs, none).collect()} == {0.0} and {r["score"] for r in Q.quality_scores(docs, none).collect()} == {0.5}
    assert {r["score"] for r in X.toxic_scores(docs, one).collect()} == {1.0} and {r["score"] for r in Q.quality_scores(docs, one).collect()} == {1.0}


def test_features_are_finite_and_of_the_whole_text():
    texts = pa.array([None, "", " ", "A!!", "x " * 5000 + "%%% &&&", "é" * 9])
    f = Q.features(texts)
    assert f.shape == (6, len(Q.FEATURES)) and np.isfinite(f).all() and f[4, Q.FEATURES.index("symbol_words")] > 0
    (w,) = words(pa.array(["Moronic moron MORON"]), ALNUM, lower=True)
    assert len(w.hashes()) == 3 and len(set(w.hashes().tolist())) == 2


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PUNCTUATION, SYMBOLS = b".,;:!?'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~"


def slow_features(text):
    """A text's features by plain loops; hash bins by the words' published hash."""
    raw = (text or "").encode()
    own = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, some = len(own), max(1, len(own))
    upper, lower, wide = (sum(map(f, raw)) for f in (lambda c: 65 <= c <= 90, lambda c: 97 <= c <= 122, lambda c: c >= 128))
    digit, mark, symbol = (sum(c in s for c in raw) for s in (b"0123456789", PUNCTUATION, SYMBOLS))
    lines = raw.count(b"\n")
    visible = max(1, len(raw) - lines - sum(c in b"\t\x0b\x0c\r " for c in raw))
    kinds = [(sum(65 <= c <= 90 for c in w), sum(97 <= c <= 122 for c in w), sum(c in SYMBOLS for c in w)) for w in own]
    pairs = list(zip(own, own[1:]))
    out = [
        math.log1p(n), upper / max(1, upper + lower + wide), digit / visible, mark / visible, symbol / visible, lines / some, wide / visible, raw.count(b"!") / some,
        sum(s > 0 for _, _, s in kinds) / some, sum(u >= 2 and not x for u, x, _ in kinds) / some, sum(s == len(w) for (_, _, s), w in zip(kinds, own)) / some,
        sum(len(w) <= 3 for w in own) / some, sum(len(w) >= 12 for w in own) / some, sum(map(len, own)) / some / 10,
        len(set(own)) / some, 1 - len(set(pairs)) / max(1, len(pairs)), math.log1p(n / (1 + lines)),
    ]
    out += [math.sqrt(out[8]), math.sqrt(out[9]), out[14] * out[0]]
    bins = collections.Counter()
    for w in own:
        (got,) = words(pa.array([w.decode()]), np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)]), lower=False)
        bins[int(got.hashes()[0]) >> 58] += 1
    out += [math.sqrt(bins[i] / some) for i in range(Q.WORD_BINS)]
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    grams = collections.Counter((int.from_bytes(low[i : i + 3], "little") * 2654435761 % 2**32) >> 26 for i in range(len(low) - 2))
    return out + [math.sqrt(grams[i] / max(1, sum(grams.values()))) for i in range(Q.GRAM_BINS)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_quality_query_against_brute_force(spark):
    """Features by plain loops, weights held against the loss they must minimise, the threshold against its quantile."""
    from tessera.llm.queries import op7_quality

    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = np.array([slow_features(t) for _, t in rows])
    assert np.allclose(x, Q.features(pa.array([t for _, t in rows], pa.string())), atol=1e-9)
    learn = [i for i, (d, _) in enumerate(rows) if labels.get(d) in (0, 1) and not held(d)]
    y = np.array([labels[rows[i][0]] for i in learn], float)
    ranker = Q.fit(x[learn], y)
    z = np.clip((x[learn] - x[learn].mean(0)) / np.maximum(x[learn].std(0), 1e-6), -8, 8)
    rng = np.random.default_rng(7)
    d = z[rng.choice(np.flatnonzero(y == 1), Q.PAIRS)] - z[rng.choice(np.flatnonzero(y == 0), Q.PAIRS)]

    def loss(w):
        return np.log1p(np.exp(-(d @ w))).mean() + Q.RIDGE / 2 * (w @ w)

    least = loss(ranker.weights)
    assert all(loss(ranker.weights + step) >= least - 1e-12 for step in rng.normal(0, 1e-2, (30, x.shape[1])))
    s = z @ ranker.weights
    assert np.quantile(s, (y == 0).mean(), method="lower") <= ranker.threshold <= np.quantile(s, (y == 0).mean(), method="higher")
    full = np.clip((x - x[learn].mean(0)) / np.maximum(x[learn].std(0), 1e-6), -8, 8) @ ranker.weights
    expected = 1 / (1 + np.exp(-(full - ranker.threshold) * ranker.scale))
    got = {r["doc_id"]: r for r in op7_quality(spark, SF).collect()}
    assert len(got) == len(rows) and all(abs(got[k]["score"] - e) < 1e-6 and got[k]["predicted"] == (e >= 0.5) for (k, _), e in zip(rows, expected))
