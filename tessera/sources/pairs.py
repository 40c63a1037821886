"""Hunks from both contents of a file: a line diff without context, numbered from 1 on either side.

Lines that stand once on each side tie the sides together (the longest chain of them that rises on
both); between two such ties, the ends that are equal are cut off, and what is left is split at the
middle of a shortest edit path until nothing is. So memory grows with the lines of a file, and time
with its lines where most of them are distinct. A side that is the other less some lines gets
exactly those lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.schemas import FILE_CHANGES

Box = tuple[int, int, int, int]


def _ties(old: list[int], new: list[int], box: Box) -> list[tuple[int, int]]:
    """Places of lines that stand once on either side of the box: the longest chain that rises on both."""
    i1, i2, j1, j2 = box
    once_old, once_new = Counter(old[i1:i2]), Counter(new[j1:j2])
    at = {new[j]: j for j in range(j1, j2) if once_new[new[j]] == 1}
    found = [(i, at[old[i]]) for i in range(i1, i2) if once_old[old[i]] == 1 and old[i] in at]
    ends: list[int] = []  # the least end of a chain of each length
    tops: list[int] = []
    before = [-1] * len(found)
    for n, (_, j) in enumerate(found):
        size = bisect_left(ends, j)
        before[n] = tops[size - 1] if size else -1
        ends[size : size + 1], tops[size : size + 1] = [j], [n]
    chain, n = [], tops[-1] if tops else -1
    while n >= 0:
        chain.append(found[n])
        n = before[n]
    return chain[::-1]


def _middle(old: list[int], new: list[int], box: Box) -> Box:
    """Begin and end of the middle run of equal lines on a shortest edit path (Myers, 1986), found from both ends at once."""
    i1, i2, j1, j2 = box
    n, m = i2 - i1, j2 - j1
    delta, odd = n - m, (n - m) % 2 != 0
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            x0, y = x, x - k
            while x < n and y < m and old[i1 + x] == new[j1 + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and abs(k - delta) < d and x + back[delta - k] >= n:
                return i1 + x0, j1 + x0 - k, i1 + x, j1 + y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            x0, y = x, x - k
            while x < n and y < m and old[i2 - 1 - x] == new[j2 - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and abs(k - delta) <= d and x + ahead[delta - k] >= n:
                return i2 - x, j2 - y, i2 - x0, j2 - (x0 - k)
    raise AssertionError("two edit paths always meet")


def equal_lines(old: list[str], new: list[str], *, tied: bool = True) -> Iterator[tuple[int, int]]:
    """Places of lines that stay, in order. Without ties, or where there are none, as many as can be."""
    names: dict[str, int] = {}
    a, b = ([names.setdefault(x, len(names)) for x in side] for side in (old, new))
    todo: list[tuple] = [(0, len(a), 0, len(b), tied)]  # boxes with whether to look for ties, and places that are known
    while todo:
        box = todo.pop()
        if len(box) == 2:
            yield box
            continue
        i1, i2, j1, j2, look = box
        while i1 < i2 and j1 < j2 and a[i1] == b[j1]:
            yield i1, j1
            i1, j1 = i1 + 1, j1 + 1
        tail = 0
        while i1 < i2 - tail and j1 < j2 - tail and a[i2 - 1 - tail] == b[j2 - 1 - tail]:
            tail += 1
        i2, j2 = i2 - tail, j2 - tail
        todo += [(i2 + t, j2 + t) for t in reversed(range(tail))]
        if i1 == i2 or j1 == j2:
            continue
        ties = _ties(a, b, (i1, i2, j1, j2)) if look else []
        if ties:
            edges = [(i1 - 1, j1 - 1), *ties, (i2, j2)]
            parts: list = []
            for (p, q), (r, s) in zip(edges, edges[1:], strict=False):
                parts += [(p + 1, r, q + 1, s, True), (r, s)]
            todo += reversed(parts[:-1])
        else:
            x, y, u, v = _middle(a, b, (i1, i2, j1, j2))
            todo += [(u, i2, v, j2, False), *((x + t, y + t) for t in reversed(range(u - x))), (i1, x, j1, y, False)]


def hunks(base: str | None, head: str | None) -> list[dict]:
    old, new = (base or "").splitlines(), (head or "").splitlines()
    out, i, j = [], 0, 0
    for p, q in (*equal_lines(old, new), (len(old), len(new))):
        if p > i or q > j:
            removed = [{"line": n + 1, "text": old[n]} for n in range(i, p)]
            added = [{"line": n + 1, "text": new[n]} for n in range(j, q)]
            out.append({"base_start": i + 1, "base_lines": len(removed), "head_start": j + 1, "head_lines": len(added), "added": added, "removed": removed})
        i, j = p + 1, q + 1
    return out


def from_pairs(pairs: DataFrame) -> DataFrame:
    """File changes from rows (cs_id, file_ord, path, kind, base_path, base_content, head_content, is_binary)."""
    names = ["cs_id", "file_ord", "path", "kind", "base_path", "base_content", "head_content", "is_binary"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [[] if binary else hunks(x, y) for x, y, binary in zip(b["base_content"], b["head_content"], b["is_binary"], strict=True)]
            yield b.assign(hunks=pd.Series(made, index=b.index, dtype=object))

    return pairs.select(*names).mapInPandas(run, FILE_CHANGES)
