"""The line diff against brute force, on large files and on awkward ones."""

from __future__ import annotations

import random
import time

from tessera.sources.pairs import equal_lines, hunks


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lines_that_stay_are_in_order_and_equal():
    r = random.Random(2)
    for n in range(400):
        letters = "ab" if n % 2 else "abcdefgh"
        a, b = ([r.choice(letters) for _ in range(r.randrange(25))] for _ in range(2))
        got = list(equal_lines(a, b))
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        assert len(got) <= longest(a, b) == len(list(equal_lines(a, b, tied=False)))


def test_a_side_that_lost_lines_lost_exactly_those():
    r = random.Random(3)
    for _ in range(300):
        a = [r.choice("abcd") + r.choice(["", "1", "2", "3"]) for _ in range(r.randrange(60))]
        b = [x for x in a if r.random() < 0.8]
        assert len(list(equal_lines(a, b))) == len(b) == len(list(equal_lines(b, a)))


def test_hunks_rebuild_the_head():
    r = random.Random(4)
    for _ in range(200):
        a, b = ("\n".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(2))
        lines, shift = a.splitlines(), 0
        for h in hunks(a, b):
            at = h["base_start"] - 1 + shift
            assert [x["text"] for x in h["removed"]] == lines[at : at + h["base_lines"]] and h["head_start"] - 1 == at
            lines[at : at + h["base_lines"]] = [x["text"] for x in h["added"]]
            shift += h["head_lines"] - h["base_lines"]
        assert lines == b.splitlines()
    assert hunks(None, None) == [] and hunks("a", "a\n") == [] and hunks(None, "a")[0]["head_lines"] == 1


def test_very_long_files():
    a = [f"line {i}" if i % 3 else "" for i in range(200_000)]
    b = [x for i, x in enumerate(a) if i % 7]
    began = time.monotonic()
    assert len(list(equal_lines(a, b))) == len(b)
    assert len(list(equal_lines(["x"] * 200_000, ["x"] * 150_000))) == 150_000
    assert time.monotonic() - began < 60
