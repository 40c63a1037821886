"""Assertions of a test's two sides, aligned.

An assertion is compared by what it claims about which expression, without the values it expects. The
alignment keeps the order of both sides and is the heaviest one: an assertion that is the same in
all is worth more than one whose expected values differ, and any pair more than none. Which pairs
these are is decided in Python, test by test; everything else is columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pairing import signature
from tessera.schemas import ASSERTION

#: Weights of a pair: one that is the same in all outweighs two that merely expect something of the same expression.
SAME, ALIKE = 3, 1


def expectation(assertion: Column) -> Column:
    """kind, callee, sense and operands, with a # for every operand that is written out as a value."""
    shown = F.transform(assertion["operands"], lambda x, i: F.when(F.coalesce(F.get(assertion["literal"], i), F.lit(False)), F.lit("#")).otherwise(x))
    return F.concat_ws(":", assertion["kind"], assertion["callee"], assertion["negated"].cast("string"), F.array_join(shown, "|"))


def pairs_of(base: list[tuple[str, str]], head: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """Places, from 0, of aligned assertions; each is given by its expectation and its whole signature."""
    low = 0
    while low < min(len(base), len(head)) and base[low] == head[low]:
        low += 1
    last = 0
    while last < min(len(base), len(head)) - low and base[-1 - last] == head[-1 - last]:
        last += 1
    old, new = base[low : len(base) - last], head[low : len(head) - last]
    # best[j]: the weight of the heaviest alignment of what is left of old with new[j:]; moves remember how it began.
    best, moves = [0] * (len(new) + 1), []
    for x in reversed(old):
        row, move = [0] * (len(new) + 1), bytearray(len(new) + 1)
        for j in range(len(new) - 1, -1, -1):
            worth = SAME if x == new[j] else ALIKE if x[0] == new[j][0] else 0
            options = [(worth + best[j + 1], 2)] if worth else []
            row[j], move[j] = max([*options, (best[j], 1), (row[j + 1], 0)], key=lambda o: o[0])
        move[len(new)] = 1
        best = row
        moves.append(move)
    out, j = [(i, i) for i in range(low)], 0
    for i in range(len(old)):
        while (step := moves[len(old) - 1 - i][j]) == 0:
            j += 1
        if step == 2:
            out.append((low + i, low + j))
            j += 1
    return [*out, *((len(base) - last + i, len(head) - last + i) for i in range(last))]


_PLACES = "array<struct<base:int,head:int>>"
_ARROW_PLACES = pa.list_(pa.struct([("base", pa.int32()), ("head", pa.int32())]))


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with the places of aligned assertions."""
    for b in batches:
        sides = [b.column(c).to_pylist() for c in ("b_expected", "b_whole", "h_expected", "h_whole")]
        found = [[{"base": i, "head": j} for i, j in pairs_of(list(zip(be, bw, strict=True)), list(zip(he, hw, strict=True)))] for be, bw, he, hw in zip(*sides, strict=True)]
        kept = [n for n in b.schema.names if n not in ("b_expected", "b_whole", "h_expected", "h_whole")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(found, _ARROW_PLACES)], names=[*kept, "places"])


def aligned_assertions(pairs: DataFrame) -> DataFrame:
    """A row for each pair of aligned assertions (was, now) that differ, of tests that stand on both sides; `ord` is the place in the head. Tests whose assertions are alike on both sides don't reach Python."""
    both = pairs.where("not removed and not added").select("cs_id", "file_ord", "path", "test_id", F.col("base_test.assertions").alias("b"), F.col("head_test.assertions").alias("h"))

    def without_lines(side: str) -> Column:
        return F.transform(side, lambda a: F.struct(signature(a), a["tolerance"], a["negated"], a["swallowed"]))

    changed = both.where(~without_lines("b").eqNullSafe(without_lines("h")))
    sides = [F.transform(side, what).alias(f"{side}_{name}") for side in ("b", "h") for name, what in (("expected", expectation), ("whole", signature))]
    schema = f"cs_id long, file_ord int, path string, test_id string, b array<{ASSERTION}>, h array<{ASSERTION}>, places {_PLACES}"
    each = changed.select("*", *sides).mapInArrow(_with_places, schema).withColumn("at", F.explode("places"))
    rows = each.select("cs_id", "file_ord", "path", "test_id", F.get("b", F.col("at.base")).alias("was"), F.get("h", F.col("at.head")).alias("now"), F.col("at.head").alias("ord"))
    return rows.where(~F.struct(signature(F.col("was")), F.col("was.tolerance"), F.col("was.swallowed")).eqNullSafe(F.struct(signature(F.col("now")), F.col("now.tolerance"), F.col("now.swallowed"))))
