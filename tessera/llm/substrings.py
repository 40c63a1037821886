"""Repeated passages between documents by prefix-partitioned suffix trees over words.

A suffix is a place of a document with at least LENGTH words after it; two suffixes hang below one
internal node of depth LENGTH exactly if their first LENGTH words are equal. Which suffixes can, and
in which group their subtree is built, is told by variable-length prefixes:

1. Of the GRAM-word sequences in a suffix's first LENGTH words the one of least hash (the leftmost of
   equals) ends the suffix's prefix. The prefix's length varies with where that anchor lies; equal
   LENGTH-word suffixes always have equal prefixes. Consecutive suffixes of one anchor are one row.
2. Spark counts the anchors. An anchor that a single document has leads to no shared node, so its
   suffixes are leaves and go no further; usually that is most of the text.
3. An anchor's suffixes are a group. Groups of at most GROUP rows fit in memory: they are dealt by
   anchor with their words, many to a task, and each gets its subtree as a suffix array with common
   prefix lengths: word names are doubled to names of 2, 4, ... words (Karp, Miller and Rosenberg), which
   sort the suffixes and tell by bisection how many words neighbours share. Intervals of neighbours that
   share LENGTH words or more are the deep internal nodes; each knows its depth and its smallest document.
4. A larger group's equal rows become one first: Spark aggregates the smallest document of each distinct
   row, and gives it back to the others, for which the whole row is a repeat. What is left is mostly a
   group that fits. Where it still doesn't, its prefixes are lengthened, each suffix a row of its own, and
   the group is split by them; at LENGTH words every group is one node. However many rows share one
   passage, no task holds them all.

A suffix repeats as many words as the deepest node above it has whose smallest document isn't its own
(a node's depth is known up to the last word of its row). Repeats merged to spans are maximal.

Defined cases: null texts have no words; texts under LENGTH words have no repeats; a passage that
only one document repeats stays; repeated rows of one id are that document, none is smaller than
itself, and each row gets the id's spans; null ids keep a row and are left out of the search; ids
that aren't whole numbers are a TypeError; an empty table gives an empty result; columns besides the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import cut, drop, hot_above, looked_up, small_batches, whole_key
from tessera.llm.wordhash import BLANK_SEPARATED, U, Words, grams, words

LENGTH = 50
GRAM = 20
#: Rows of one anchor whose subtree one task may build.
GROUP = 4096
_BATCH_BYTES = 1 << 19


def prefixes(w: Words, h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, first suffixes, numbers of consecutive suffixes) of a chunk; suffixes are word numbers of the chunk."""
    n = len(h) - length + 1
    if n < 1:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = grams(h, gram)
    reach = length - gram + 1  # sequences to choose from
    at, have = np.arange(len(g)), 1
    while have < reach:
        step = min(have, reach - have)
        left, right = at[:-step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        have += step
    at = at[:n]
    text = w.text_of()
    inside = np.flatnonzero(text[:n] == text[length - 1 :])
    if not len(inside):
        return np.zeros(0, U), inside, inside
    anchor = at[inside]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[inside[1:]] != text[inside[:-1]])])
    return g[anchor[new]], inside[new], np.diff(np.r_[new, len(inside)])


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("k").to_numpy()
            for w in words(b.column("text"), BLANK_SEPARATED, lower=False):
                anchor, first, n = prefixes(w, w.hashes(), length, gram)
                text = np.searchsorted(w.cut, first, "right") - 1
                order = np.lexsort((first, anchor, text))
                anchor, first, n, text = anchor[order], first[order], n[order], text[order]
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])][: len(anchor)])
                cuts = pa.array(np.r_[new, len(anchor)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[new].view(np.int64)), pa.array(key[w.first + text[new]]), pa.ListArray.from_arrays(cuts, pa.array((first - w.cut[text]).astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32)))],
                    names=["anchor", "k", "firsts", "sizes"],
                )

    return run


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([None if t is None else z.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], names=["k", "z"])


def unzipped(column: pa.Array) -> pa.Array:
    """The texts of zipped ones; null is empty."""
    z = zstandard.ZstdDecompressor()
    return pa.array(["" if v is None else z.decompress(v).decode() for v in column.to_pylist()], pa.large_string())


def _slices(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _branches(length: int):
    """Rows of a document's shared anchors with the words that their suffixes reach over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in _slices(whole_batch):
                lists, key = b.column("anchors").to_pylist(), b.column("k").to_numpy()
                for w in words(unzipped(b.column("z")), BLANK_SEPARATED, lower=False):
                    out: list[tuple] = []
                    for t in range(w.texts):
                        base = int(w.cut[t])
                        for a in lists[w.first + t]:
                            # A branch that the document repeats is one row with several places. Blanks between words don't count.
                            own: dict[tuple, list[int]] = {}
                            for first, n in zip(a["firsts"], a["sizes"], strict=True):
                                f = base + first
                                own.setdefault((n, b" ".join(w.buf[w.start[f] : w.end[f + n + length - 2]].tobytes().split())), []).append(first)
                            out.extend((a["anchor"], a["large"], int(key[w.first + t]), firsts, n, branch.decode()) for (n, branch), firsts in own.items())
                    cols = list(zip(*out, strict=True)) or [()] * 6
                    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["anchor", "large", "k", "firsts", "n", "branch"])

    return run


def doubled(symbols: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, ranks) of the sequences of 1, 2, 4, ... and at last `depth` symbols: equal ranks are equal sequences, and ranks sort as these do."""
    name = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    have = 1
    yield have, name
    while have < depth:
        step = min(have, depth - have)
        pair = name[:-step] * (int(name.max(initial=0)) + 1) + name[step:]
        name = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        have += step
        yield have, name


def names_at_depth(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the depth-symbol sequences from each place on that has that many."""
    *_, (_, name) = doubled(symbols, depth)
    return name


def suffix_array(symbols: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start at `at`, and how many symbols each shares with the one before it.

    Texts lie one after the other, each ended by a 0, which no text has; `left` counts a suffix's symbols."""
    longest = int(left.max(initial=1))
    levels = list(doubled(np.r_[symbols, np.zeros(4 * longest, symbols.dtype)], longest))
    order = np.argsort(levels[-1][1][at], kind="stable")
    i, j = at[order[:-1]], at[order[1:]]
    shared = np.zeros(len(i), np.int64)
    for have, name in reversed(levels):
        shared[name[i + shared] == name[j + shared]] += have
    # Beyond a text's end two suffixes may share what follows; both end there then.
    return order, np.r_[np.zeros(min(1, len(at)), np.int64), np.minimum(shared, left[order[1:]])]


def depths(lcp: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, in order, the depth of the deepest internal node above it that has a smaller owner below, or 0 if none of `length` symbols or more has.

    The nodes of depth v are the intervals whose suffixes share v symbols with the one before; deeper ones lie within them."""
    out = np.zeros(len(lcp), np.int64)
    at = np.arange(len(lcp))
    for v in np.unique(lcp[lcp >= length]):
        leaf = lcp < v
        inside = ~leaf | np.r_[~leaf[1:], False]
        at, lcp, owner = at[inside], lcp[inside], owner[inside]
        first = lcp < v
        least = np.minimum.reduceat(owner, np.flatnonzero(first))
        out[at[least[np.cumsum(first) - 1] < owner]] = v
    return out


def _runs(depth: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, stop, depth) of the runs of suffixes with a depth; row r has n[r] suffixes. A run stops where the repeats of its suffixes do."""
    own = np.flatnonzero(depth)
    row = np.repeat(np.arange(len(n)), n)[own]
    place = own - (np.cumsum(n) - n)[row]
    if not len(own):
        return row, place, place, place
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
    return row[new], place[new], np.maximum.reduceat(place + depth[own], new), np.maximum.reduceat(depth[own], new)


def _subtrees(length: int):
    """Repeats in groups that lie one after the other, sorted by anchor."""

    def build(t: pa.Table) -> pa.RecordBatch:
        key, n = t.column("k").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        parts = [(w.hashes(), w.cut) for w in words(t.column("branch"), BLANK_SEPARATED, lower=False)]
        sizes = np.concatenate([np.diff(c) for _, c in parts])
        start = np.cumsum(sizes + 1) - sizes - 1
        symbols = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        text = np.ones(len(symbols), bool)
        text[start + sizes] = False
        symbols[text] = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)[1] + 1
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        # Suffixes that share LENGTH words have one anchor, so no node lies in two groups.
        order, lcp = suffix_array(symbols, start[row] + place, sizes[row] - place)
        depth = np.zeros(len(row), np.int64)
        depth[order] = depths(lcp, key[row[order]], length)
        row, low, high, deep = _runs(depth, n)
        firsts = t.column("firsts").combine_chunks()
        cuts, places = firsts.offsets.to_numpy(), firsts.values.to_numpy()
        many = cuts[row + 1] - cuts[row]
        at = np.arange(int(many.sum())) + np.repeat(cuts[row] - np.cumsum(many) + many, many)
        k, s, e = np.repeat(key[row], many), places[at] + np.repeat(low, many), places[at] + np.repeat(high, many)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *(pa.array(c.astype(np.int32)) for c in (s, e, np.repeat(deep, many)))], names=["k", "start", "stop", "depth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole_batch in batches:
            for b in _slices(whole_batch, 1024):
                held.append(b)
                size += b.column("branch").nbytes
                if size < _BATCH_BYTES:
                    continue
                t = pa.Table.from_batches(held)
                anchor = t.column("anchor").to_numpy()
                to = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
                if to:
                    yield build(t.slice(0, to).combine_chunks())
                    t = t.slice(to).combine_chunks()
                held, size = t.to_batches(), t.column("branch").nbytes
        if held:
            yield build(pa.Table.from_batches(held).combine_chunks())

    return run


def _lengthened(length: int, prefix: int):
    """A row for each suffix, its group the first `prefix` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in _slices(whole_batch, 2048):
                n = b.column("n").to_numpy().astype(np.int64)
                firsts = b.column("firsts").to_pylist()
                for w in words(b.column("branch"), BLANK_SEPARATED, lower=False):
                    own = n[w.first : w.first + w.texts]
                    row = np.repeat(np.arange(w.texts), own)
                    offset = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
                    at = w.cut[:-1][row] + offset
                    named = b.slice(w.first, w.texts).take(pa.array(row))
                    branch = [w.buf[w.start[i] : w.end[i + length - 1]].tobytes().decode() for i in at]
                    places = [[f + o for f in firsts[w.first + r]] for r, o in zip(row.tolist(), offset.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams(w.hashes(), prefix)[at].view(np.int64)), named.column("k"), pa.array(places, pa.list_(pa.int32())), pa.array(np.ones(len(at), np.int32)), pa.array(branch, pa.string())],
                        names=["anchor", "k", "firsts", "n", "branch"],
                    )

    return run


_ROWS = "anchor long, k long, firsts array<int>, n int, branch string"


def repeated_spans(documents: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Rows (k, spans): for documents that have some, the spans [start, stop) of words that an earlier document has too, not yet merged, and the depth of their deepest node."""
    rows = small_batches(documents).select(whole_key(documents, key).alias("k"), F.col(text).alias("text")).where("k is not null and text is not null")
    anchors = cut(rows.mapInArrow(_anchor_rows(length, gram), "anchor long, k long, firsts array<int>, sizes array<int>"))
    shared = anchors.groupBy("anchor").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.sum(F.size("firsts")).alias("rows"), F.count(F.lit(1)).alias("n")).where("least < most")
    found = looked_up(anchors, shared.withColumn("large", F.col("rows") > group), ["anchor"], "large", "k", hot_above(anchors.count())).where("large is not null")
    lists = found.groupBy("k").agg(F.collect_list(F.struct("anchor", "large", "firsts", "sizes")).alias("anchors"))
    branches = cut(lists.join(zipped(rows), "k").mapInArrow(_branches(length), "anchor long, large boolean, k long, firsts array<int>, n int, branch string"))
    drop(anchors)
    fitting, spans = branches.where(~F.col("large")).drop("large"), []
    rest = branches.where("large").drop("large")
    for prefix in (gram, (gram + length) // 2, length):
        if prefix > gram:
            rest = cut(rest.mapInArrow(_lengthened(length, prefix), _ROWS))
        if not (many := rest.count()):
            break
        # Equal rows are one: to all but the smallest document each of their words is a repeat.
        named = rest.withColumn("id", F.md5("branch"))
        known = looked_up(named, named.groupBy("id").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("n")), ["id"], "least", "k", hot_above(many))
        known = cut(known.select("anchor", "k", "firsts", "n", F.when(F.col("k") == F.col("least"), F.col("branch")).alias("branch")))
        ends = F.transform("firsts", lambda f: F.struct(f.alias("start"), (f + F.col("n") + length - 1).alias("stop"), (F.col("n") + length - 1).alias("depth")))
        spans.append(known.where("branch is null").select("k", ends.alias("spans")))
        if prefix == length:
            break  # what is left of a group is one row
        least = known.where("branch is not null")
        sizes = least.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).withColumn("fits", F.col("n") <= group)
        sized = looked_up(least.withColumnRenamed("n", "suffixes"), sizes, ["anchor"], "fits", "k", hot_above(many)).withColumnRenamed("suffixes", "n")
        fitting = fitting.unionByName(sized.where("fits").drop("fits"))
        rest = sized.where("not fits").drop("fits")
    trees = fitting.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_subtrees(length), "k long, start int, stop int, depth int")
    every = trees.select("k", F.array(F.struct("start", "stop", "depth")).alias("spans"))
    for some in spans:
        every = every.unionByName(some)
    return every.groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def zipped(rows: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled."""
    return rows.mapInArrow(_zip, "k long, z binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole_batch in batches:
        for b in _slices(whole_batch):
            spans = b.column("spans").to_pylist()
            n_words, n_removed = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            kept: list[str] = [""] * b.num_rows
            merged: list[list[dict]] = [[] for _ in kept]
            for w in words(unzipped(b.column("z")), BLANK_SEPARATED, lower=False):
                n_words[w.first : w.first + w.texts] = np.diff(w.cut)
                gone = np.zeros(len(w.start) + 1, np.int64)
                for t in range(w.texts):
                    for s in spans[w.first + t] or ():
                        gone[w.cut[t] + s["start"]] += 1
                        gone[w.cut[t] + s["stop"]] -= 1
                away = np.cumsum(gone)[:-1] > 0
                for t in range(w.texts):
                    i, j = int(w.cut[t]), int(w.cut[t + 1])
                    n_removed[w.first + t] = int(away[i:j].sum())
                    # bytes.split() knows the ASCII blanks alone, as the words do.
                    kept[w.first + t] = b" ".join([x for x, a in zip(w.buf[w.start[i] : w.end[j - 1]].tobytes().split(), away[i:j], strict=True) if not a]).decode() if j > i else ""
                    edges = np.flatnonzero(np.diff(np.r_[False, away[i:j], False]))
                    own = spans[w.first + t] or ()
                    deep = np.zeros(len(edges) // 2, np.int64)
                    np.maximum.at(deep, np.searchsorted(edges[::2], [s["start"] for s in own], "right") - 1, [s["depth"] for s in own])
                    merged[w.first + t] = [{"start": int(a), "stop": int(e), "depth": int(d)} for a, e, d in zip(edges[::2], edges[1::2], deep, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("depth", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.string()), pa.array(merged, kind)], names=["k", "n_words", "n_removed", "kept", "repeats"])


def remove_repeats(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Rows (key, n_words, n_removed, kept, repeats), one for each row of `documents`: what stays of the text, and the maximal repeats as word spans with the depth of the deepest node in each."""
    spans = repeated_spans(documents, key=key, text=text, **how)
    rows = documents.select(whole_key(documents, key).alias("k"), F.col(text).alias("text"))
    return zipped(rows).join(spans, "k", "left").mapInArrow(_kept, "k long, n_words long, n_removed long, kept string, repeats array<struct<start:int,stop:int,depth:int>>").withColumnRenamed("k", key)
