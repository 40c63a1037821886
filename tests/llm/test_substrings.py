from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tessera.llm import substrings as S

from llm_cases import SCHEMA, make


def brute(rows, length):
    first = {}
    lists = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in lists:
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in lists:
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < i:
                gone |= set(range(s, s + length))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    base = [f"t{i}" for i in range(400)]
    out = [None, "", "a b " * 60, "a b " * 70, "z " * 200]
    passage = r.choices(base, k=70)
    for i in range(60):
        w = r.choices(base, k=r.randrange(5, 120))
        if i % 3 == 0:
            a = r.randrange(20)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + r.randrange(8, 60)]
        if i % 7 == 0 and i:
            w = out[-1].split() + w[:3]
        out.append(r.choice([" ", "\n", "  "]).join(w))
    return [*out, out[10], out[11]]


@pytest.mark.parametrize(("length", "gram", "group"), [(12, 4, 4096), (12, 4, 3), (12, 4, 0), (12, 12, 2), (50, 20, 5)])
def test_against_brute_force(spark, texts, length, gram, group):
    docs = spark.createDataFrame(make(texts), SCHEMA).repartition(5)
    rows = S.remove_repeats(docs, length=length, gram=gram, group=group).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows} == brute([(i, t) for i, t in enumerate(texts)], length)
    for r in rows:
        assert sum(s["stop"] - s["start"] for s in r["repeats"]) == r["n_removed"]


def test_names_are_suffix_ranks():
    r = np.random.default_rng(1)
    symbols = r.integers(0, 3, 200).astype(np.uint64)
    for depth in (1, 2, 3, 7, 50):
        names = S.names_at_depth(symbols, depth)
        own = [tuple(symbols[i : i + depth]) for i in range(len(symbols) - depth + 1)]
        order = {x: i for i, x in enumerate(sorted(set(own)))}
        assert names.tolist() == [order[x] for x in own]


def test_odd_rows(spark, mess):
    rows = S.remove_repeats(mess).collect()
    assert len(rows) == mess.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["n_removed"] == 0 and by[6]["n_removed"] == by[6]["n_words"] == 20_000 and by[6]["kept"] == ""
    assert by[0]["n_words"] == 0 and by[10]["kept"] == "é\x00 ñ \x1c z"
    assert S.remove_repeats(mess.limit(0)).count() == 0


def test_suffix_arrays_and_depths():
    r = np.random.default_rng(4)
    for _ in range(40):
        texts = [r.integers(1, 3, r.integers(6, 14)).tolist() for _ in range(12)]
        owner = r.integers(0, 6, len(texts))
        start = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        symbols = np.array([x for t in texts for x in [*t, 0]])
        own = [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 3)]
        at, left = np.array([start[i] + p for i, p in own]), np.array([len(texts[i]) - p for i, p in own])
        order, lcp = S.suffix_array(symbols, at, left)
        suffix = [texts[i][p:] for i, p in own]
        ordered = [suffix[o] for o in order]
        assert [s[:4] for s in ordered] == sorted(s[:4] for s in suffix)

        def common(a, b):
            return next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

        assert lcp.tolist() == [0, *[common(a, b) for a, b in zip(ordered, ordered[1:], strict=False)]]
        doc = owner[[own[o][0] for o in order]]
        got = S.depths(lcp, doc, 4)
        for a, d, n in zip(ordered, doc, got, strict=True):
            deepest = max((common(a, b) for b, e in zip(ordered, doc, strict=True) if e < d), default=0)
            assert n == (deepest if deepest >= 4 else 0)


def test_hot_groups_are_split_and_keys_are_whole(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(50)]
    passage = r.choices(base, k=20)
    texts = [" ".join([*r.choices(base, k=r.randrange(4)), *passage, *r.choices(base, k=r.randrange(9))]) for _ in range(900)]
    docs = spark.createDataFrame(make(texts), SCHEMA).repartition(7)
    for group in (0, 40, 4096):
        rows = S.remove_repeats(docs, length=12, gram=4, group=group).collect()
        assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in rows} == brute(list(enumerate(texts)), 12)
        assert all(12 <= s["depth"] <= s["stop"] - s["start"] for x in rows for s in x["repeats"])
    for key in ("CAST(doc_id AS string)", "doc_id / 2"):
        with pytest.raises(TypeError, match="whole number"):
            S.remove_repeats(docs.selectExpr(f"{key} AS doc_id", "text"))
