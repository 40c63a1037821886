"""Connected components of a link table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import cut, drop, hot_above, looked_up


def _star(edges: DataFrame, above: int | None, *, large: bool) -> DataFrame:
    """Each node's neighbours on one side are linked to the least node of its neighbourhood instead. Edges are (a, b), a < b.

    A large component's least node is an end of most of its edges; nodes of more than `above` edges are looked up without dealing by node.
    """
    if large:  # to larger neighbours, with the least over all neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        moved = looked_up(edges, least, ["a"], "m", "b", above).select(F.col("m").alias("a"), "b")
    else:  # to smaller neighbours
        least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = looked_up(edges, least, ["b"], "m", "a", above)
        moved = joined.select(F.col("m").alias("a"), F.col("a").alias("x")).where("a < x").select("a", F.col("x").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b"))
    moved = moved.where("a < b")
    return moved if large else moved.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", *, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge: component is the least node reachable.

    Each round writes its edges to the shared folder, so that lineage stays short; the rounds grow
    with the logarithm of the longest path. Nothing of the graph comes to the driver but two sums.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    before, last = None, cut(edges)
    above = hot_above(last.count())
    for _ in range(most_rounds):
        outer = cut(_star(last, above, large=True))
        edges = cut(_star(outer, above, large=False))
        drop(last, outer)
        last = edges
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end of {most_rounds} rounds")
    # At the end every edge goes from a component's least node to another of its nodes.
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
