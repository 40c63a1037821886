"""An exact n-gram Jaccard self-join with several global token orders, and its linked groups.

A document's set has its distinct K-word shingles, as 64-bit hashes. Equal sets are one class with
one representative; only representatives are joined, so copies are never expanded into pairs. Two
sets of Jaccard similarity t or more share at least t of the larger one's tokens, so under any global
order of tokens they share one among the first n - ceil(t n) + 1: the prefix. Steps:

1. Frequent tokens (those of SHARE of all documents or more, counted in each partition and summed)
   go last in every order; their number is bounded by the mean set size over SHARE. Other tokens are
   ordered by a hash, another one for each order.
2. Prefixes under the first order are dealt by token. A token with at most BUCKET representatives
   gives the pairs that pass the length and the positional bound.
3. In a bucket of more than BUCKET representatives ("hot") the set with the fewest tokens of its own,
   that is outside the frequent ones, is the centre; every other is paired with it, so the pairs grow
   with the rows and not with their square; the rows are dealt to their centre in parts of about PART,
   so no task gets a whole hot bucket. As frequent tokens come last, a set with too many of its own never
   gets to those of a large group of near copies and drops out at once.
4. Candidates must also share enough prefix tokens under the second and under the third order (as many
   as a linked pair can't do without). What is left of the intersection is verified on the sets.
5. Links so far are merged to components. In hot buckets that still hold several components, pairs of
   different components that no bound and no order excludes are verified too. So no link between
   different components is lost, and links within a component change nothing. A bucket of more than
   MANY components, as unrelated sets that share a token make, is dealt by the token and each prefix
   token under the second order: the orders are intersected in the join, so sets that share one token
   alone never meet.

Components come from alternating stars over the verified links.

Defined cases: null and empty texts have the empty set, no links and their own id as component; a
text of fewer than K words is one shingle; equal texts of several ids are one class; repeated rows
give a row each; null ids keep a row with a null component of their own; an empty table gives an
empty result; columns besides the key and the text are not read. An id with several texts is linked by
each of them, and they are one document's: all its rows have one component. Keys are whole numbers, else
TypeError tells so.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.substrings import zipped
from tessera.llm.tables import cut, drop, hot_above, looked_up, small_batches, whole_key
from tessera.llm.wordhash import BLANK_SEPARATED, U, Words, grams, mix, words

K = 5
#: Linked at this share of the union or more: numerator and denominator.
THRESHOLD = (80, 100)
SHARE = 1 / 4096
LEAST_FREQUENT = 16
BUCKET = 16
PART = 256
#: Hot buckets that hold more components than this are dealt by the second order too. Below it the pairs of a row are
#: told apart in less time than it takes to deal the row once for each token of its second prefix.
MANY = 1024
_ORDERS = (U(0x51), U(0xA7), U(0x3D))
#: A bound on the table of frequent tokens; beyond it the less frequent ones are ordered by hash like others.
MOST_FREQUENT = 200_000


def _sets(w: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, sorted distinct shingles) of the texts of a chunk that have words."""
    h = w.hashes()
    g = grams(h, k)
    for t in range(w.texts):
        i, j = int(w.cut[t]), int(w.cut[t + 1])
        if j - i >= k:
            yield t, np.unique(g[i : j - k + 1])
        elif j > i:
            yield t, grams(h[i:j], j - i, salt=k - (j - i))


def shingle_set(text: str, k: int = K) -> np.ndarray:
    for w in words(pa.array([text]), BLANK_SEPARATED, lower=True):
        for _, s in _sets(w, k):
            return s
    return np.zeros(0, U)


def _frequent(k: int, share: float):
    """(token, n): tokens that at least `share` of a partition's documents have, and 2 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, docs, fresh, size = np.zeros(0, U), np.zeros(0, np.int64), 0, [], 0

        def merged():
            """What is held, counted, with what was counted before. An order may rest on counts that miss tokens seen once so far."""
            x = np.concatenate(fresh)
            fresh.clear()
            x.sort()
            again = np.flatnonzero(x[1:] == x[:-1])
            new = np.flatnonzero(np.diff(again, prepend=-2) > 1)
            every, n = x[again[new]], np.diff(new, append=len(again)) + 1
            both, at = np.unique(np.concatenate([keys, every]), return_inverse=True)
            return both, np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)

        for b in batches:
            for w in words(b.column("text"), BLANK_SEPARATED, lower=True):
                docs += w.texts
                for _, s in _sets(w, k):
                    fresh.append(s)
                    size += len(s)
                if size > 4_000_000:
                    keys, counts = merged()
                    size = 0
        if fresh:
            keys, counts = merged()
        own = counts >= max(2, share * docs)
        yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array(counts[own])], names=["token", "n"])

    return run


def _prefix_length(n: int, num: int, den: int) -> int:
    return n + (-n * num) // den + 1


def _least(order: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values, in order."""
    at = np.argpartition(order, n - 1)[:n] if n < len(order) else np.arange(len(order))
    return at[np.argsort(order[at])]


def _signatures(frequent, k: int, num: int, den: int, orders: int):
    """(k, n, f1, f2, own, p1, p2, p3): set size, two hashes of the set, tokens that aren't frequent, prefixes under three orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, tier = frequent.value
        for b in batches:
            n, own, f = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32), np.zeros((2, b.num_rows), U)
            p1, p2, p3 = ([None] * b.num_rows for _ in range(3))
            for w in words(b.column("text"), BLANK_SEPARATED, lower=True):
                for t, s in _sets(w, k):
                    at = w.first + t
                    n[at] = len(s)
                    f[0, at], f[1, at] = mix(s + U(1)).sum(), mix(s ^ U(0x5BD1E995)).sum()
                    if not orders:
                        continue
                    last = np.zeros(len(s), U)
                    if len(token):
                        i = np.minimum(np.searchsorted(token, s), len(token) - 1)
                        last = np.where(token[i] == s, tier[i], U(0))
                    own[at] = int((last == 0).sum())
                    size = _prefix_length(len(s), num, den)
                    first = _least(mix(s ^ _ORDERS[0]) >> U(8) | last, size)
                    p1[at] = s[first].view(np.int64)
                    p2[at], p3[at] = ((s[_least(mix(s ^ salt) >> U(8) | last, size)] & U(0xFFFF)).astype(np.uint16).view(np.int16) for salt in _ORDERS[1:])
            cols = [b.column("k"), pa.array(n), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64))]
            names = ["k", "n", "f1", "f2"]
            if orders:
                cols += [pa.array(own), pa.array(p1, pa.list_(pa.int64())), pa.array(p2, pa.list_(pa.int16())), pa.array(p3, pa.list_(pa.int16()))]
                names += ["own", "p1", "p2", "p3"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


_SIGNATURE = "k long, n int, f1 long, f2 long"


def _verified(k: int, num: int, den: int):
    """(a, b, linked) of pairs with both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(key: int, body: bytes) -> np.ndarray:
            s = recent.pop(key, None)
            if s is None:
                s = shingle_set(z.decompress(body).decode(), k)
            recent[key] = s
            if len(recent) > 512:
                recent.popitem(last=False)
            return s

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1024):
                b = whole_batch.slice(at, 1024)
                out = []
                for x, y, zx, zy in zip(*(b.column(c).to_pylist() for c in ("a", "b", "za", "zb")), strict=True):
                    s, t = of(x, zx), of(y, zy)
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    out.append(den * common >= num * (len(s) + len(t) - common))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    return run


def _could(na, nb, ia, ib, num: int, den: int):
    """The length bound, and the positional bound of a token at places ia and ib."""
    least, most = F.least(na, nb), F.greatest(na, nb)
    # Needed overlap: t / (1 + t) of both sizes.
    return (least * den >= most * num) & ((1 + F.least(na - ia - 1, nb - ib - 1)) * (den + num) >= (na + nb) * num)


def _alike(pa_: str, pb: str, na: str, nb: str, num: int, den: int):
    """Whether two prefixes under one order share as many tokens as a linked pair must.

    Of the set whose prefix ends first in the order, every prefix token that the other lacks is missing from the
    other set; a linked pair may miss n - overlap of them. Which one ends first isn't known here, so the weaker
    demand counts. Tokens are kept as 16-bit values: equal values of different tokens can only let a pair through,
    and values that repeat within a prefix are added back.
    """
    a, b = F.col(pa_), F.col(pb)
    need = F.expr(f"({num} * ({na} + {nb}) + {num + den - 1}) div {num + den}").cast("int")
    shared = F.size(F.array_intersect(a, b)) + F.size(a) - F.size(F.array_distinct(a))
    return F.arrays_overlap(a, b) & (shared >= F.least(F.size(a) - (F.col(na) - need), F.size(b) - (F.col(nb) - need)))


MEMBER_BITS = 1 << 25


def only_members(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (k, text), less most of those whose k isn't among ids: a Bloom filter of MEMBER_BITS bits, whatever the
    number of ids, so that they needn't be shuffled. It lets all members through; with far more ids than bits it lets everything through."""
    spots = F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.pmod(F.xxhash64("k", i), F.lit(MEMBER_BITS)))
    bits = ids.select(F.explode(spots).alias("s")).groupBy(F.floor(F.col("s") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("b"))
    words_ = np.zeros(MEMBER_BITS // 32, np.uint32)
    for batch in bits.toArrow().to_batches():  # at most one row for each 32 bits
        words_[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(words_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i in range(3):
                s = b.column(f"s{i}").to_numpy()
                keep &= (shared.value[s >> 5] >> (s & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
            yield b.select(["k", "text"]).filter(pa.array(keep))

    marked = rows.select("k", "text", *[F.pmod(F.xxhash64("k", F.lit(i)), F.lit(MEMBER_BITS)).alias(f"s{i}") for i in range(3)])
    return marked.mapInArrow(run, "k long, text string")


def _bucket_pairs(rows: DataFrame, keys: list[str], num: int, den: int, more=None) -> DataFrame:
    """Pairs (a, b), a < b, of rows (*keys, k, n, i, ...) with equal keys, the first a token, that the bounds let through."""
    x, y = rows.alias("x"), rows.alias("y")
    where = (F.col("x.k") < F.col("y.k")) & _could(F.col("x.n"), F.col("y.n"), F.col("x.i"), F.col("y.i"), num, den)
    for key in keys:
        where &= F.col(f"x.{key}") == F.col(f"y.{key}")
    if more is not None:
        where &= more
    return x.join(y, where).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()


def _dealt(pairs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The pairs with a part for each member, (a, b, pa, pb), and what gives rows of members (k, ...) once for each part of k.

    A set that is in very many pairs, as the centre of a large group is, has a part for every so many of them."""
    above = hot_above(pairs.count())
    if above is None:
        return pairs.select("a", "b", F.lit(0).alias("pa"), F.lit(0).alias("pb")), lambda rows: rows.withColumn("part", F.lit(0))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").count().where(F.col("count") > above)
    hot = degree.select("k", (F.floor(F.col("count") / above) + 1).alias("parts"))

    def part(side: str, other: str):
        found = F.broadcast(hot.select(F.col("k").alias(side), F.col("parts").alias(f"parts_{side}")))
        return found, F.coalesce(F.pmod(F.xxhash64(other), F.col(f"parts_{side}")), F.lit(0).cast("long")).alias(f"p{side}")

    (of_a, pa), (of_b, pb) = part("a", "b"), part("b", "a")
    dealt = pairs.join(of_a, "a", "left").join(of_b, "b", "left").select("a", "b", pa, pb)

    def members(rows: DataFrame) -> DataFrame:
        every = F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)
        return rows.join(F.broadcast(hot), "k", "left").withColumn("part", F.explode(every)).drop("parts")

    return dealt, members


def _told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (k, text) under keys that tell texts apart, and the pairs of keys that are of one id. Usually no id has several texts; then the rows are as given."""
    seen = rows.groupBy("k").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    several = seen.where("low < high").select("k", F.lit(True).alias("several"))
    if several.isEmpty():
        return rows, None
    apart = cut(rows.join(several, "k", "left").withColumn("own", F.when(F.col("several"), F.xxhash64("k", "text")).otherwise(F.col("k"))))
    ties = apart.where("several").select("k", "own").distinct()
    ties = ties.groupBy("k").agg(F.min("own").alias("a")).join(ties, "k").where("a <> own").select("a", F.col("own").alias("b"))
    return apart.select(F.col("own").alias("k"), "text"), ties


def link_classes(documents: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, threshold: tuple[int, int] = THRESHOLD, share: float = SHARE, bucket: int = BUCKET, many: int = MANY) -> tuple[DataFrame, DataFrame, bool]:
    """(classes, links, apart): rows (rep, n, f1, f2, copies) of the classes of equal sets, the verified links (a, b) that join their
    components, and whether an id has several texts, so that reps aren't ids."""
    num, den = threshold
    spark = documents.sparkSession
    rows = small_batches(documents).where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(whole_key(documents, key).alias("k"), F.col(text).alias("text"))
    rows, ties = _told_apart(rows)
    counted = rows.mapInArrow(_frequent(k, share), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    least = max(LEAST_FREQUENT, share * rows.count())
    common = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
    token = np.array([r["token"] for r in common], np.int64).view(U)
    at = np.argsort(token)
    # The tier, the more frequent the later, is the first byte of a token's place in an order.
    tiers = np.array([min(255, 1 + int(4 * np.log2(r["n"]))) for r in common], U) << U(56)
    frequent = spark.sparkContext.broadcast((token[at], tiers[at]))

    signed = rows.mapInArrow(_signatures(frequent, k, num, den, 3), f"{_SIGNATURE}, own int, p1 array<long>, p2 array<short>, p3 array<short>").where("n > 0")
    reps = cut(signed.groupBy("n", "f1", "f2").agg(F.min(F.struct("k", "own", "p1", "p2", "p3")).alias("s"), F.count(F.lit(1)).alias("copies")).select("n", "f1", "f2", "copies", "s.*"))
    prefix = reps.select("k", "n", "own", F.posexplode("p1").alias("i", "token"))
    crowd = prefix.groupBy("token").count().where("count > 1")
    # A hot bucket has a part for each PART rows of it, so what is dealt by it lies on many tasks.
    parts = F.when(F.col("count") > bucket, F.floor(F.col("count") / PART) + 1).otherwise(0)
    above = hot_above(reps.agg(F.coalesce(F.sum(F.size("p1")), F.lit(0))).first()[0])
    shared = looked_up(prefix, crowd.select("token", parts.alias("parts"), F.col("count").alias("n")), ["token"], "parts", "k", above)
    shared = cut(shared.where("parts is not null").withColumn("part", F.expr("if(parts > 0, pmod(xxhash64(k), parts), null)")).withColumn("hot", F.col("parts") > 0))

    met: list[DataFrame] = []

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs that the second and the third order let through."""
        met.append(cut(pairs))
        dealt, members = _dealt(met[-1])
        mine = members(reps.select("k", "n", "p2", "p3"))
        both = dealt.join(mine.toDF("a", "na", "a2", "a3", "pa"), ["a", "pa"]).join(mine.toDF("b", "nb", "b2", "b3", "pb"), ["b", "pb"])
        return both.where(_alike("a2", "b2", "na", "nb", num, den) & _alike("a3", "b3", "na", "nb", num, den)).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs with whether they are linked, after a look at both sets. Only texts of their members are shuffled."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        texts = zipped(only_members(rows, ids)).join(ids, "k").dropDuplicates(["k"])
        texts = cut(texts)
        dealt, members = _dealt(pairs)
        both = members(texts.select("k", "z"))
        near, far = both.toDF("a", "za", "pa"), both.toDF("b", "zb", "pb")
        out = cut(dealt.join(near, ["a", "pa"]).join(far, ["b", "pb"]).select("a", "b", "za", "zb").mapInArrow(_verified(k, num, den), "a long, b long, linked boolean"))
        drop(texts)
        return out

    # The frequent tokens come last, so a set with too many of its own never reaches those of a large group.
    rare = shared.where("hot")
    centres = rare.groupBy("token").agg(F.min(F.struct("own", "k", "n", "i")).alias("c"), F.max("parts").alias("parts"))
    centres = centres.select("token", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    star = rare.drop("parts").join(centres, ["token", "part"]).where((F.col("k") != F.col("c.k")) & _could(F.col("n"), F.col("c.n"), F.col("i"), F.col("c.i"), num, den)).select(F.least("k", "c.k").alias("a"), F.greatest("k", "c.k").alias("b"))
    cold = _bucket_pairs(shared.where(~F.col("hot")).select("token", "k", "n", "i"), ["token"], num, den)
    candidates = cut(likely(cold.unionByName(star).distinct()))
    first = verified(candidates)
    links = first.where("linked").select("a", "b")

    placed = cut(rare.select("token", "k", "n", "i").join(components(links), rare["k"] == F.col("node"), "left").withColumn("component", F.coalesce("component", "k")).drop("node"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.approx_count_distinct("component").alias("held"), F.count(F.lit(1)).alias("n")).where("low < high")
    several = looked_up(placed, mixed.select("token", (F.col("held") > many).alias("crowded"), F.col("n")), ["token"], "crowded", "k", above).where("crowded is not null").groupBy("k", "n", "component").agg(F.array_sort(F.collect_list(F.struct("i", "token", "crowded"))).alias("own"))
    # A pair meets at the first of these tokens that it shares, so it comes once and with the strictest bound. Should
    # an earlier shared token lie in a bucket that isn't among these, the pair was met there or is one component.
    several = several.select("k", "n", "component", "own", F.posexplode("own").alias("at", "t"))
    before = F.transform(F.slice("own", F.lit(1), F.col("at")), lambda t: t["token"])
    several = cut(several.select(F.col("t.token").alias("token"), "k", "n", F.col("t.i").alias("i"), "component", before.alias("before"), F.col("t.crowded").alias("crowded")))
    apart = (F.col("x.component") != F.col("y.component")) & ~F.arrays_overlap("x.before", "y.before")
    across = _bucket_pairs(several.where("not crowded").drop("crowded"), ["token"], num, den, apart)
    crowded = several.where("crowded").drop("crowded")
    if not crowded.isEmpty():
        # A linked pair shares a prefix token under the second order too, so it still meets where a bucket is dealt by these: at the first of them.
        second = crowded.join(reps.select("k", F.array_distinct("p2").alias("p2")), "k").select("token", "k", "n", "i", "component", "before", "p2", F.posexplode("p2").alias("at", "t2"))
        second = second.withColumn("before2", F.slice("p2", F.lit(1), F.col("at"))).drop("p2", "at")
        across = across.unionByName(_bucket_pairs(second, ["token", "t2"], num, den, apart & ~F.arrays_overlap("x.before2", "y.before2")))
    rest = cut(likely(across.join(first.select("a", "b"), ["a", "b"], "left_anti")))
    last = verified(rest)
    every = links.unionByName(last.where("linked").select("a", "b"))
    every = cut(every if ties is None else every.unionByName(ties))
    drop(shared, candidates, first, placed, several, rest, last, *met)
    return reps.select(F.col("k").alias("rep"), "n", "f1", "f2", "copies"), every, ties is not None


def one_of_each(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `documents`, all columns as they are, without those whose group has a smaller key; of repeated rows of a key one stays, and all rows of null keys."""
    stay = jaccard_components(documents, key=key, text=text, **how).where(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = documents.where(F.col(key).isNotNull()).join(stay, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(documents.where(F.col(key).isNull())).select(*documents.columns)


def jaccard_components(documents: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, **how) -> DataFrame:
    """Rows (key, n_shingles, component_id), one for each row of `documents`."""
    classes, links, apart = link_classes(documents, key=key, text=text, k=k, **how)
    found = components(links)
    named = classes.join(found, classes["rep"] == found["node"], "left").select(F.col("n").alias("size"), "f1", "f2", F.coalesce("component", "rep").alias("component"), F.col("copies").alias("n"))
    above = hot_above(classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    nothing = documents.sparkSession.sparkContext.broadcast((np.zeros(0, U), np.zeros(0, U)))
    signed = rows.mapInArrow(_signatures(nothing, k, 1, 1, 0), _SIGNATURE)
    # A text of very many copies is one class; its rows aren't dealt by it.
    out = looked_up(signed.withColumnRenamed("n", "size"), named, ["size", "f1", "f2"], "component", "k", above).select("k", F.col("size").alias("n"), "component")
    if apart:
        # Components have names that needn't be ids: the least id of each is looked up, a row for each component.
        least = out.where("component is not null").groupBy("component").agg(F.min("k").alias("least"))
        out = out.join(least, "component", "left").select("k", "n", F.col("least").alias("component"))
    return out.select(F.col("k").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "k").alias("component_id"))
