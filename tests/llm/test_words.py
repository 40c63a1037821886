from __future__ import annotations

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import wordhash as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9é日 \t\n\x0b\x1c-.z\x00", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_the_contracts(texts):
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    for table, lower, pattern in ((W.BLANK_SEPARATED, False, r"[^\x20\x09-\x0D]+"), (W.ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = [[] for _ in texts]
        for w in W.words(column, table, lower=lower):
            for k in range(w.texts):
                got[w.first + k] = [w.word(i).decode() for i in range(w.cut[k], w.cut[k + 1])]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or "" for t in texts]
        assert got == [re.findall(pattern, t) for t in low]


def test_hashes_follow_words_across_chunks(monkeypatch):
    texts = ["b a", "a b a", "", "ab", "a" * 300 + " b"] * 7
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(W, "CHUNK_BYTES", size)
        seen: dict[int, set] = {}
        for w in W.words(pa.array(texts), W.BLANK_SEPARATED, lower=False):
            for i, h in enumerate(w.hashes()):
                seen.setdefault(int(h), set()).add(w.word(i))
        assert sorted(map(len, seen.values())) == [1, 1, 1, 1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_grams(k):
    (w,) = W.words(pa.array(["a b a b", "a b"]), W.BLANK_SEPARATED, lower=False)
    g = W.grams(w.hashes(), k)
    inside = W.whole(w.cut, k, len(g))
    assert len(set(g[inside].tolist())) == {1: 2, 2: 2, 3: 2}[k] and inside.sum() == {1: 6, 2: 4, 3: 2}[k]
