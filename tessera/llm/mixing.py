"""Mixing sources to target weights by a Pfair schedule, in DataFrame functions alone.

A source's documents are dealt in blocks of BLOCK. Time is slots, one block each. Weights are whole
parts w of a total W, so nothing is rounded: a source's k-th block (from 0) may not start before slot
floor(k W / w) and must be done by slot ceil((k + 1) W / w). Of the released blocks the one with the
earliest deadline takes the slot (of equal ones the heavier source's, then by name). As the shares sum
to 1 every deadline is met, so after any number of slots t each source has had less than one block
more or less than t w / W. The schedule repeats after W slots: one such period is worked out by a fold
over its slots, and a block's slot is

    (block div w) * W + slot of the (block mod w)-th turn of its source in the period.

Sources of equal weight take turns in order, so the fold's state has a number for each distinct
weight, not for each source.

Without given weights a source's is the root of its size in hundredths of the largest's, 1 at least.
Given weights need not sum to 1. Whole numbers, fractions and decimals are taken as they are, a float
as the nearest fraction with a denominator of at most a million, or exactly where that would be 0, so
no weight above 0 is ever lost; together they must make at most MOST_PARTS parts, else ValueError tells so.

A source that ends leaves its later slots empty, so the others keep their proportions among each
other; `position` counts documents in the order of their slots without gaps, from counts by chunks of
slots. No row is sorted globally, dropped or repeated. Inside a source documents are numbered by
(bucket, id), a bucket being a prefix of the id's hash, from counts by bucket; so a source with a third
of all rows is spread too.

Defined cases: a null source is the source ''; null ids are numbered first in bucket ''; repeated rows
are documents of their own; sources without a given weight, or with weight 0, have no part in the mix:
their rows have null slot and position and come last in order; a negative weight is an error; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import cut

BLOCK = 16
#: Default weights: parts of the largest source.
PARTS = 100
#: A bound on the period that given weights make, and so on the schedule that is broadcast.
MOST_PARTS = 1 << 20
#: Slots of the fold's inner loop; slots of a chunk, and chunks of a span, for positions.
STEP, CHUNK, SPAN = 1024, 64, 1024


def whole_parts(weights: dict[str, float | int | str | Fraction | Decimal]) -> dict[str, int]:
    """The weights as whole numbers without a common divisor, in exactly the given proportions."""
    exact = {k: (Fraction(v).limit_denominator(1_000_000) or Fraction(v)) if isinstance(v, float) else Fraction(v) for k, v in weights.items()}
    if any(v < 0 for v in exact.values()):
        raise ValueError(f"weights must not be negative: {weights}")
    scale = math.lcm(*(v.denominator for v in exact.values()))
    parts = {k: int(v * scale) for k, v in exact.items()}
    common = math.gcd(*parts.values()) or 1
    parts = {k: v // common for k, v in parts.items()}
    if sum(parts.values()) > MOST_PARTS:
        raise ValueError(f"these weights make {sum(parts.values())} parts, more than {MOST_PARTS}; give them with fewer digits")
    return parts


def targets(sizes: DataFrame, weights: dict | None = None) -> DataFrame:
    """One row: sources, an array of (w, names, n) by falling weight w with the sources of that weight, and period, the sum of their weights."""
    if weights is None:
        w = F.expr(f"greatest(1L, cast(floor({PARTS} * sqrt(n) / sqrt(most) + 0.5) as bigint))")
        weighed = sizes.agg(F.collect_list(F.struct("source", "n")).alias("all"), F.max("n").alias("most")).select(F.inline("all"), "most").withColumn("w", w)
    else:
        given = F.create_map(*[F.lit(x) for k, v in whole_parts(weights).items() for x in (k, v)]) if weights else F.expr("cast(map() as map<string,int>)")
        weighed = sizes.withColumn("w", F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0)).cast("long"))
    classes = weighed.where("w > 0").groupBy("w").agg(F.array_sort(F.collect_list("source")).alias("names"))
    one = classes.agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("less"), "w", "names"))).alias("sources"))
    return one.select("sources", F.expr("aggregate(sources, 0L, (a, x) -> a + x.w * size(x.names))").alias("period"))


def schedule(one: DataFrame) -> DataFrame:
    """Rows (source, w, turn, slot, period) of one period: the turn-th block of a source goes to slot."""
    turn = "(get(s.done, i) div size(x.names))"
    candidate = f"case when {turn} * period div x.w <= t then struct((({turn} + 1) * period + x.w - 1) div x.w as deadline, i as i, get(s.done, i) as q) end"
    step = f"""transform(array(array_min(transform(sources, (x, i) -> {candidate}))), p -> named_struct(
        'done', transform(s.done, (d, j) -> d + if(j = p.i, 1L, 0L)), 'out', array_append(s.out, named_struct('i', p.i, 'q', p.q))))[0]"""
    none = "cast(array() as array<struct<i:int,q:bigint>>)"
    inner = f"aggregate(sequence(b, least(b + {STEP}L, period) - 1), named_struct('done', f.done, 'out', {none}), (s, t) -> {step}, s -> named_struct('done', s.done, 'out', array_append(f.out, s.out)))"
    fold = f"aggregate(sequence(0L, period - 1, {STEP}L), named_struct('done', transform(sources, x -> 0L), 'out', cast(array() as array<array<struct<i:int,q:bigint>>>)), (f, b) -> {inner}, f -> flatten(f.out))"
    turned = one.where("period > 0").select("sources", "period", F.posexplode(F.expr(fold)).alias("slot", "o")).withColumn("x", F.expr("get(sources, o.i)"))
    return turned.select(F.expr("get(x.names, cast(o.q % size(x.names) as int))").alias("source"), "x.w", F.expr("o.q div size(x.names)").alias("turn"), F.col("slot").cast("long").alias("slot"), "period")


def _dealt(documents: DataFrame, weights: dict | None, key: str, source: str, block: int, *, carry: bool) -> DataFrame:
    """Rows (k, source, index, block, slot); with `carry`, `all` has all columns of a document."""
    whole = [F.struct(*[documents[c] for c in documents.columns]).alias("all")] if carry else []
    rows = documents.select(*whole, F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    rows = rows.withColumn("bucket", F.coalesce(F.substring(F.md5(F.col("k").cast("string")), 1, 3), F.lit("")))
    # A row for each source and bucket that has documents.
    counts = cut(rows.select("source", "bucket").groupBy("source", "bucket").count())
    one = cut(targets(counts.groupBy("source").agg(F.sum("count").alias("n")), weights))
    # As many rows as the period has slots: MOST_PARTS at most for given weights, else PARTS for each source.
    plan = cut(schedule(one))
    weight = one.select(F.inline("sources")).select("w", F.explode("names").alias("source"))
    starts = counts.select("source", "bucket", (F.sum("count").over(Window.partitionBy("source").orderBy("bucket")) - F.col("count")).alias("from"))
    # Fewer rows than the plan has.
    starts = starts.join(F.broadcast(weight), "source", "left")
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy("source", "bucket").orderBy(F.col("k").asc_nulls_first())))
    # Merged, for both sides are dealt and sorted by these keys already; the starts grow with the sources.
    placed = numbered.join(starts.hint("merge"), ["source", "bucket"]).withColumn("index", F.col("from") + F.col("row") - 1).withColumn("block", F.expr(f"`index` div {block}"))
    placed = placed.withColumn("turn", F.col("block") % F.col("w")).join(F.broadcast(plan.drop("w").withColumnRenamed("slot", "at")), ["source", "turn"], "left")
    return placed.select("k", "source", "index", "block", F.expr("(block div w) * period + at").alias("slot"), *(["all"] if carry else []))


def mixed(documents: DataFrame, weights: dict | None = None, *, key: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """Rows (key, source, block, slot, position), one for each row of `documents`."""
    placed = cut(_dealt(documents, weights, key, source, block, carry=False).withColumn("chunk", F.expr(f"slot div {CHUNK}")))
    # Documents before a chunk: those of earlier spans, and of earlier chunks of its span.
    counts = placed.where("chunk is not null").groupBy("chunk").count().withColumn("span", F.expr(f"chunk div {SPAN}"))
    spans = counts.groupBy("span").agg(F.sum("count").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("span")) - F.col("n"))
    starts = counts.withColumn("inside", F.sum("count").over(Window.partitionBy("span").orderBy("chunk")) - F.col("count")).join(spans.select("span", "base"), "span").select("chunk", (F.col("base") + F.col("inside")).alias("from"))
    scheduled = placed.where("chunk is not null").withColumn("row", F.row_number().over(Window.partitionBy("chunk").orderBy("slot", F.col("index") % block)))
    out = scheduled.join(starts.hint("merge"), "chunk").select("k", "source", "block", "slot", (F.col("from") + F.col("row") - 1).alias("position"))
    out = out.unionByName(placed.where("chunk is null").select("k", "source", "block", "slot", F.lit(None).cast("long").alias("position")))
    return out.withColumnRenamed("k", key)


def in_mixed_order(documents: DataFrame, weights: dict | None = None, *, key: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The rows of `documents`, all columns as they are, in the order of their slots: by partition and within. Rows out of the mix come last."""
    order = [F.col("slot").asc_nulls_last(), F.col("source"), F.col("index")]
    return _dealt(documents, weights, key, source, block, carry=True).repartitionByRange(*order).sortWithinPartitions(*order).select("all.*")
