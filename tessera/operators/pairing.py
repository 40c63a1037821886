"""Strength of assertions and tests, and base and head tests paired by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schemas import STRENGTH


def strength(kind: Column) -> Column:
    """The rank of an assertion kind; null for a kind that isn't one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair]), kind)


def signature(assertion: Column) -> Column:
    """kind:callee:operands; neither line, tolerance nor negation count."""
    return F.concat_ws(":", assertion["kind"], assertion["callee"], F.array_join(assertion["operands"], "|"))


def is_skipped(test: Column) -> Column:
    """Any marker but a focus on other tests."""
    return F.exists(test["skip_markers"], lambda m: m["reason"] != "exclusive_focus")


def will_run(test: Column) -> Column:
    return test["is_discoverable"] & ~is_skipped(test)


def total_strength(test: Column) -> Column:
    return F.aggregate(test["assertions"], F.lit(0).cast("long"), lambda n, a: n + F.coalesce(strength(a["kind"]), F.lit(0)))


def test_rows(surfaces: DataFrame, *more: str) -> DataFrame:
    """A row for each test of parsed surfaces: keys, test_ord, test_id, will_run, n_assertions, strength, test, and `more` columns of the surface."""
    t = F.col("test")
    rows = surfaces.select("cs_id", "file_ord", "path", "side", *more, F.posexplode("tests").alias("test_ord", "test"))
    return rows.select("cs_id", "file_ord", "path", "side", "test_ord", t["id"].alias("test_id"), will_run(t).alias("will_run"), F.size(t["assertions"]).cast("long").alias("n_assertions"), total_strength(t).alias("strength"), "test", *more)


def surface_totals(rows: DataFrame) -> DataFrame:
    """By surface: tests, assertions of all of them, strength of those that will run."""
    return rows.groupBy("cs_id", "path", "side").agg(
        F.count(F.lit(1)).alias("n_tests"), F.sum(F.col("will_run").cast("long")).alias("n_running"), F.sum("n_assertions").alias("n_assertions"),
        F.coalesce(F.sum(F.when(F.col("will_run"), F.col("strength"))), F.lit(0)).cast("long").alias("strength"),
    )


def by_id(rows: DataFrame) -> DataFrame:
    """One row for each test id of a surface: of repeated ids the last counts, at the first one's place."""
    kept = [c for c in rows.columns if c not in ("cs_id", "path", "side", "test_id", "test_ord")]
    last = F.max_by(F.struct(*kept), "test_ord")
    return rows.groupBy("cs_id", "path", "side", "test_id").agg(F.min("test_ord").alias("test_ord"), last.alias("last")).select("cs_id", "path", "side", "test_id", "test_ord", "last.*")


def comparable(surfaces: DataFrame) -> DataFrame:
    """Surfaces of files both of whose sides are known: parsed or rightly absent. They are read once."""
    file = Window.partitionBy("cs_id", "path")
    known = F.min(F.col("status").isin("parsed", "absent").cast("int")).over(file)
    return surfaces.withColumn("_known", known).withColumn("_sides", F.count(F.lit(1)).over(file)).where("_known = 1 and _sides >= 2").drop("_known", "_sides")


def pair_tests(rows: DataFrame) -> DataFrame:
    """Base and head tests matched by id, from rows of test_rows() of comparable files, in one pass: of repeated ids of a side the last
    counts, at the first one's place. Base order first, then head-only tests: pair_ord sorts them. A missing side has no strength."""
    kept = [c for c in rows.columns if c not in ("cs_id", "file_ord", "path", "side", "test_id", "test_ord")]

    def side(name: str) -> list[Column]:
        own = F.col("side") == name
        # A file of a change comes once; the order within it decides, its place among the files only between files of one path.
        at = F.when(own, F.shiftleft(F.col("test_ord").cast("long"), 32) + F.coalesce("file_ord", F.lit(0)))
        return [F.min(F.when(own, F.col("test_ord"))).alias(f"{name}_test_ord"), *[F.max_by(c, at).alias(f"{name}_{c}") for c in kept]]

    both = rows.where(F.col("side").isin("base", "head")).groupBy("cs_id", "path", "test_id").agg(*side("base"), *side("head"))
    base, head = F.coalesce("base_strength", F.lit(0)), F.coalesce("head_strength", F.lit(0))
    return both.select(
        "*", F.col("head_test_ord").isNull().alias("removed"), F.col("base_test_ord").isNull().alias("added"), (head - base).cast("long").alias("strength_delta"),
        F.struct(F.col("base_test_ord").isNull().cast("int").alias("late"), F.coalesce("base_test_ord", "head_test_ord").alias("ord")).alias("pair_ord"),
    )
