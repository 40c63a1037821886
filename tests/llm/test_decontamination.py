from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination as D

from llm_cases import SCHEMA, make


def wordlist(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, size=10):
    windows = {}
    for item, text in items:
        w = wordlist(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item) if item is not None else None)
    out = []
    for t in texts:
        w, hit, named = wordlist(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(x for x in named if x is not None)))
    return out


@pytest.fixture(scope="module")
def case():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "OF", "é1"]
    items = [(i, " ".join(r.choices(vocabulary, k=n))) for i, n in enumerate([30, 12, 10, 9, 3, 1, 0, 25])] + [(None, " ".join(r.choices(vocabulary, k=11))), (8, None), (9, "the the the the the the the the the the the the")]
    items.append((10, items[0][1]))
    texts = [None, "", "the the " * 20]
    for _ in range(60):
        parts = r.choices(vocabulary, k=r.randrange(40))
        _, text = r.choice(items)
        w = (text or "").split()
        a = r.randrange(len(w) + 1)
        parts[len(parts) // 2 : len(parts) // 2] = w[a : a + r.randrange(1, 20)]
        texts.append(r.choice([" ", ", ", "\n"]).join(parts))
    return items, texts


@pytest.mark.parametrize("block", [50_000, 7])
def test_against_brute_force(spark, case, block):
    items, texts = case
    docs, bench = spark.createDataFrame(make(texts), SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    rows = D.benchmark_hits(docs, bench, block_windows=block).select("doc_id", "n_words", D.n_hit().alias("n"), "items").orderBy("doc_id").collect()
    assert [(r["n_words"], r["n"], r["items"]) for r in rows] == brute(texts, items)


def test_odd_rows(spark, mess):
    bench = spark.createDataFrame([(1, "three little words")], "item_id long, text string")
    rows = D.benchmark_hits(mess, bench).collect()
    assert len(rows) == mess.count() and sorted(r["doc_id"] for r in rows if r["hits"]) == [7, 7, 8]
    clean = D.without_contaminated(mess, bench)
    assert clean.schema == mess.schema and clean.count() == mess.count() - 3
    kept = mess.where("doc_id is null or doc_id not in (7, 8)")
    assert clean.exceptAll(kept).count() == 0
    assert {r["n_words"] for r in rows if r["text"] is None} == {0}


def test_empty_tables(spark, mess):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.benchmark_hits(mess, none).where(F.size("hits") > 0).count() == 0
    assert D.benchmark_hits(mess.limit(0), none).count() == 0
