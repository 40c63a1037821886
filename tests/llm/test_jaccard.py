from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard as J
from tessera.llm.components import components

from llm_cases import SCHEMA, make


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def closure(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(texts, k=3, num=90):
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return [(len(s), c) for s, c in zip(sets, closure(len(sets), links), strict=True)]


@pytest.fixture(scope="module")
def texts():
    """Families of near copies from 0 to 20 % apart, chains of small steps, copies, short texts."""
    r = random.Random(4)
    out = [None, "", "one", "One", "two words", "two  WORDS"]
    for size in (40, 90, 200):
        base = [f"v{r.randrange(5000)}" for _ in range(size)]
        for _ in range(30):
            w = list(base)
            for _ in range(r.randrange(max(1, size // 25))):
                w[r.randrange(size)] = f"m{r.randrange(10**6)}"
            out.append(" ".join(w))
        for _ in range(8):
            base[r.randrange(size)] = f"c{r.randrange(10**6)}"
            out.append("\n".join(base))
    common = " ".join(f"k{i}" for i in range(30))
    out += [f"{common} u{i} u{i + 1} {'pad ' * (i % 4)} r{r.randrange(9**9)} s{r.randrange(9**9)} t{r.randrange(9**9)}" for i in range(40)]
    r.shuffle(out)
    return [*out, *out[:9]]


@pytest.mark.parametrize(("bucket", "share", "k", "num", "many"), [(16, 1 / 4096, 3, 90, 64), (2, 1 / 4096, 3, 90, 64), (1, 0.05, 3, 90, 0), (1000, 1.0, 3, 90, 64), (16, 1 / 4096, 5, 80, 64), (1, 0.05, 5, 80, 0)])
def test_against_brute_force(spark, texts, bucket, share, k, num, many):
    docs = spark.createDataFrame(make(texts), SCHEMA).repartition(4)
    rows = J.jaccard_components(docs, bucket=bucket, share=share, k=k, threshold=(num, 100), many=many).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == brute(texts, k, num)


def test_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, f"{a} q"), (2, b), (3, f"{b} q"), (4, c), (5, c), (5, c), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((r["doc_id"], r["component_id"]) for r in J.jaccard_components(docs).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (5, 5)]
    assert sorted(r["doc_id"] for r in J.one_of_each(docs).collect()) == [1, 4, 5]
    with pytest.raises(TypeError, match="whole number"):
        J.jaccard_components(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_a_token_of_many_unrelated_sets_makes_few_candidates(spark, monkeypatch):
    """4000 short sets that share one word run, frequent but not among the last: pairs stay far below the square."""
    r = random.Random(6)
    texts = [f"one shared run of words {' '.join(f'w{r.randrange(10**7)}' for _ in range(12))}" for _ in range(4000)] + [f"one shared run of words {' '.join(f'z{i}' for i in range(12))}", f"one shared run of words {' '.join(f'z{i}' for i in range(12))} q"]
    counts = []
    plain = J._bucket_pairs

    def counted(*a, **b):
        out = plain(*a, **b)
        counts.append(out.count())
        return out

    monkeypatch.setattr(J, "_bucket_pairs", counted)
    rows = J.jaccard_components(spark.createDataFrame(make(texts), SCHEMA), share=1.0).collect()
    assert sum(r["component_id"] != r["doc_id"] for r in rows) == 1
    assert sum(counts) < 20 * len(texts)


def test_one_of_each(spark, texts):
    docs = spark.createDataFrame(make(texts), SCHEMA)
    kept = J.one_of_each(docs)
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute(texts, 5, 80)})


def test_odd_rows(spark, mess):
    rows = J.jaccard_components(mess).collect()
    assert len(rows) == mess.count()
    by = {r["doc_id"]: r for r in rows}
    assert (by[6]["component_id"], by[8]["component_id"], by[0]["component_id"], by[2]["n_shingles"]) == (5, 7, 0, 0)
    kept = J.one_of_each(mess)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10] and kept.where("doc_id is null").count() == 2
    assert J.jaccard_components(mess.limit(0)).count() == 0


def test_prefix_length():
    for n in range(1, 300):
        assert J._prefix_length(n, 90, 100) == n - -(-9 * n // 10) + 1


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(200), 100 + r.randrange(200)) for _ in range(120)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = closure(400, [(a, b) for a, b in links if a is not None])
    assert got == {n: expected[n] for a, b in links if a is not None and a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0


def test_hot_keys_are_split(spark, monkeypatch):
    """The ways for keys that hold very many rows give what the plain ones give."""
    monkeypatch.setattr("tessera.llm.tables.LEAST_HOT", 2)
    body = [f"w{i}" for i in range(60)]
    texts = [" ".join(body)] * 9 + [" ".join([*body[:i], "x" + str(i), *body[i + 1 :]]) for i in range(12)] + ["alone here", "", "one two three four"]
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bucket=2).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute(texts, 5, 80)]
    path = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 120)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(path).collect()} == {(i, 0) for i in range(21)} | {(i, 100) for i in range(100, 120)}
