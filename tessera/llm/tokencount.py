"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is the space mark U+2581 and a word `[^\\x20\\x09-\\x0D]+`. The best segmentation has the
least total cost; a piece costs round(1000 * log2(rank + 16)) by its rank in the vocabulary (a
Zipf prior: nothing is trained), a byte outside all pieces costs BYTE_COST and is one token. Of
equal costs the one with fewer tokens counts.

The distinct pre-tokens of a chunk of text that weren't met before go into one trie, level by level:
a node is a distinct prefix. A node's forward score is computed once however many words share it, from
the scores of its ancestors and the pieces that end at it; a word's count is stored at its terminal
node. Counts go into a bounded cache of the worker, so a word that comes again isn't walked again. Documents are
never shuffled and a document's counts are summed where it lies.

Defined cases: a null or empty text has no pre-tokens and no tokens; repeated rows give a row each;
an empty table an empty result; a word longer than LONG bytes takes the same recurrence alone, in
numbers without a bound; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.wordhash import _BASE, BLANK_SEPARATED, U, _power, mix, words

MARK = "▁".encode()
LONG = 160
BYTE_COST = 40_000
CACHE_WORDS = 1 << 20
#: In the trie a score is cost << SHIFT | tokens, so that the least score is the least cost, then the fewest tokens.
SHIFT = 24


@dataclass
class Vocabulary:
    cost: dict[bytes, int]
    keys: np.ndarray  # sorted hashes
    value: np.ndarray  # their scores
    bits: np.ndarray
    lengths: list[int]


def _polynomial(piece: bytes) -> int:
    h, p = 0, 1
    for c in piece:
        h, p = h + (c + 1) * p & (1 << 64) - 1, p * _BASE & (1 << 64) - 1
    return h


def vocabulary(pieces: list[str]) -> Vocabulary:
    """From pieces by rank."""
    cost: dict[bytes, int] = {}
    for rank, piece in enumerate(pieces):
        cost.setdefault(piece.encode(), round(1000 * math.log2(rank + 16)))
    hashes = mix(np.array([_polynomial(p) for p in cost], U))
    at = np.argsort(hashes)
    bits = np.zeros(1 << 20, bool)
    bits[(hashes >> U(44)).astype(np.int64)] = True
    value = np.array([(c << SHIFT) + 1 for c in cost.values()], np.int64)
    return Vocabulary(cost, hashes[at], value[at], bits, sorted({len(p) for p in cost}))


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]


def count_one(v: Vocabulary, word: bytes) -> int:
    """The recurrence for one pre-token of any length, in a plain loop over unbounded numbers."""
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        s = best[end - 1][0] + BYTE_COST, best[end - 1][1] + 1
        for n in v.lengths:
            if n > end:
                break
            if (c := v.cost.get(word[end - n : end])) is not None:
                s = min(s, (best[end - n][0] + c, best[end - n][1] + 1))
        best.append(s)
    return best[-1][1]


_MARK_HASH = U(_polynomial(MARK))
_MARK_POWER = U(pow(_BASE, len(MARK), 1 << 64))


def count_trie(v: Vocabulary, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Token counts of distinct words, MARK before each: their places in the bytes and their lengths. One trie holds them all."""
    n, widest, mark = len(length), int(length.max(initial=0)), len(MARK)
    out = np.zeros(n, np.int64)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    power, inverse = _power(len(buf))
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * power[: len(buf)], out=sums[1:])
    reaching = np.searchsorted(-length, -np.arange(widest + 1), "right")

    def piece(best: np.ndarray, hashes: np.ndarray, before) -> None:
        """Lowers scores where a piece ends: its cost on top of the score before it."""
        h = mix(hashes)
        at = np.flatnonzero(v.bits[(h >> U(44)).astype(np.int64)])
        if len(at):
            i = np.minimum(np.searchsorted(v.keys, h[at]), len(v.keys) - 1)
            own = v.keys[i] == h[at]
            at, i = at[own], i[own]
            best[at] = np.minimum(best[at], before(at) + v.value[i])

    # The mark is the root's edge; below it a node is a distinct prefix of words.
    root = count_one_score(v, MARK)
    node = [np.zeros(n, np.int64)]  # of each word at each depth
    score = [np.array([root])]
    for d in range(1, widest + 1):
        m = int(reaching[d])
        prefix = (sums[start[:m] + d] - sums[start[:m]]) * inverse[start[:m]]
        key, first, inside = np.unique(prefix, return_index=True, return_inverse=True)
        best = score[d - 1][node[d - 1][first]] + ((BYTE_COST << SHIFT) + 1)
        at_d = sums[start[first] + d]
        for k in v.lengths:
            if k == d + mark:  # a piece that takes the mark in
                piece(best, _MARK_HASH + key * _MARK_POWER, lambda at: 0)
            if k > d:
                continue
            low = start[first] + (d - k)
            piece(best, (at_d - sums[low]) * inverse[low], lambda at, k=k, d=d, first=first: score[d - k][node[d - k][first[at]]])
        node.append(inside)
        score.append(best)
        ends = slice(int(reaching[d + 1]) if d < widest else 0, m)
        out[order[ends]] = best[inside[ends]] & (1 << SHIFT) - 1
    return out


def count_one_score(v: Vocabulary, word: bytes) -> int:
    """The packed score of a short pre-token."""
    best = [0]
    for end in range(1, len(word) + 1):
        pieces = (best[end - n] + (v.cost[word[end - n : end]] << SHIFT) + 1 for n in v.lengths if n <= end and word[end - n : end] in v.cost)
        best.append(min([best[end - 1] + (BYTE_COST << SHIFT) + 1, *pieces]))
    return best[-1]


class Counter:
    """Counts of words by their hash, kept up to a bound."""

    def __init__(self, v: Vocabulary):
        self.v, self.keys, self.counts = v, np.zeros(0, U), np.zeros(0, np.int64)

    def count(self, w) -> np.ndarray:
        """Tokens of each word of a chunk."""
        key, first, inside = np.unique(w.hashes(), return_index=True, return_inverse=True)
        out = np.zeros(len(key), np.int64)
        i = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = self.keys[i] == key if len(self.keys) else np.zeros(len(key), bool)
        out[known] = self.counts[i[known]]
        fresh = np.flatnonzero(~known)
        size = (w.end - w.start)[first[fresh]]
        for f in fresh[size > LONG]:
            out[f] = count_one(self.v, MARK + w.word(int(first[f])))
        short = fresh[size <= LONG]
        if len(short):
            out[short] = count_trie(self.v, w.buf, w.start[first[short]], size[size <= LONG])
        if len(self.keys) + len(fresh) > CACHE_WORDS:
            self.keys, self.counts = key, out
        elif len(fresh):
            keys = np.concatenate([self.keys, key[fresh]])
            at = np.argsort(keys, kind="stable")
            self.keys, self.counts = keys[at], np.concatenate([self.counts, out[fresh]])[at]
        return out[inside]


def token_counts(documents: DataFrame, pieces: list[str], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_pretokens, n_tokens), one for each document. The vocabulary is broadcast; its size is its own, not the data's."""
    shared = documents.sparkSession.sparkContext.broadcast(pieces)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(shared.value))
        for b in batches:
            n_words, n_tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for w in words(b.column("text"), BLANK_SEPARATED, lower=False):
                if len(w.start):
                    sums = np.concatenate([[0], np.cumsum(counter.count(w))])
                    n_words[w.first : w.first + w.texts] = np.diff(w.cut)
                    n_tokens[w.first : w.first + w.texts] = sums[w.cut[1:]] - sums[w.cut[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n_words), pa.array(n_tokens)], names=[key, "n_pretokens", "n_tokens"])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_pretokens long, n_tokens long")
