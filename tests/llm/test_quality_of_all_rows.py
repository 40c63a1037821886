"""A ranker learns from all learnable rows, not from as many as the driver takes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import quality as Q


def test_more_rows_than_the_driver_takes(spark):
    rng = np.random.default_rng(3)
    words = ["river", "stone", "light", "evening", "house", "market", "letter", "winter"]
    rows, y = [], []
    for i in range(1500):
        good = rng.random() > 0.1
        text = " ".join(rng.choice(words, rng.integers(5, 60))) + ("." if good else " $$$ !!! CLICK") * int(rng.integers(1, 3))
        rows.append((i, text))
        y.append(int(good != (rng.random() < 0.05)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
    learn = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 != 1]
    x, own = Q.features(pa.array([rows[i][1] for i in learn])), np.array([y[i] for i in learn])
    ranker = Q.train(docs, labels, bound=100)
    assert np.allclose(ranker.mean, x.mean(0), atol=1e-5) and np.allclose(ranker.spread, np.maximum(x.std(0), 1e-6), atol=1e-4)
    s = ranker.strength(x)
    share = (own == 0).mean()
    assert np.quantile(s, share, method="lower") - 1e-3 <= ranker.threshold <= np.quantile(s, share, method="higher") + 1e-3
    # The blocks' loss is at its least: no small step lowers that over all pairs by much.
    z = np.clip((x - ranker.mean) / ranker.spread, -8, 8)

    def loss(w):
        d = (z[own == 1] @ w)[:, None] - (z[own == 0] @ w)[None, :]
        return np.log1p(np.exp(-np.clip(d, -500, 500))).mean() + Q.RIDGE / 2 * (w @ w)

    assert loss(ranker.weights) < loss(Q.fit(x[:100].astype(float), own[:100].astype(float)).weights) and loss(ranker.weights) < 0.8 * np.log(2)
    # Repeated runs agree.
    assert np.allclose(Q.train(docs.repartition(3), labels, bound=100).weights, ranker.weights, atol=1e-6)
