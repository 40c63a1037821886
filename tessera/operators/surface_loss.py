"""Extension rules over paired tests: what a change took from the tests themselves.

These follow one-line descriptions, not an implementation; see the README. They need surfaces: files
with a side that is unknown or unparsed never fire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dealing import growing
from tessera.functions.paths import detect_language
from tessera.operators.alignment import aligned_assertions, expectation
from tessera.operators.imports import handed_on, import_edges, module_names, prefixes
from tessera.operators.pairing import comparable, pair_tests, signature, test_rows
from tessera.operators.rules import Context, evidence, rule, text

KEYS = ("cs_id", "file_ord", "path")


def pairs(context: Context) -> DataFrame:
    """Paired tests of files whose sides are both known, made once for all rules: a source is parsed once, whether they are kept or one rule alone reads them once."""
    if context.surfaces is None:
        raise ValueError("this rule needs surfaces")

    def make() -> DataFrame:
        return pair_tests(test_rows(comparable(context.surfaces))).join(growing(context.files.select(*KEYS)), ["cs_id", "path"])

    return context.once("pairs", make)


def _rows(p: DataFrame, title: str | Column, detail: Column, line: Column, side: str | Column, order: Column | None = None) -> DataFrame:
    return p.select(*KEYS, (F.lit(title) if isinstance(title, str) else title).alias("title"), detail.alias("detail"), F.array(evidence(line, side, F.col("test_id"))).alias("evidence"), F.lit(0).alias("check_ord"), (order if order is not None else F.col("pair_ord.ord")).alias("line_ord"))


@rule("VID001", "Test removed or undiscoverable", severity="high", penalty=25)
def removed(context: Context) -> DataFrame:
    p = pairs(context)
    lost = p.where("base_test.is_discoverable and (removed or not added and not head_test.is_discoverable)")
    gone = F.col("removed")
    title = F.when(gone, "Test removed").otherwise("Test no longer discoverable")
    detail = text("`", F.col("test_id"), F.when(gone, "` no longer exists.").otherwise("` is no longer collected."))
    line, side = F.when(gone, F.col("base_test.line_start")).otherwise(F.col("head_test.line_start")), F.when(gone, "base").otherwise("head")
    return _rows(lost, title, detail, line, side)


@rule("VID002", "Assertion removed", severity="high", penalty=20)
def assertion_removed(context: Context) -> DataFrame:
    p = pairs(context).where("not removed and not added")
    was, now = F.transform("base_test.assertions", signature), F.transform("head_test.assertions", signature)

    def times(signatures: Column, s: Column) -> Column:
        return F.size(F.filter(signatures, lambda x: x == s))

    # Equal assertions count as often as they stand there.
    lost = F.exists(F.array_distinct(was), lambda s: times(was, s) > times(now, s))
    fewer = p.where(lost & (F.col("head_n_assertions") < F.col("base_n_assertions")))
    return _rows(fewer, "Assertion removed", text("`", F.col("test_id"), "` lost ", (F.col("base_n_assertions") - F.col("head_n_assertions")).cast("string"), " assertion(s)."), F.col("base_test.line_start"), "base")


@rule("VID003", "Test skipped", severity="high", penalty=15)
def skipped(context: Context) -> DataFrame:
    p = pairs(context).where("not removed")
    real = F.filter("head_test.skip_markers", lambda m: m["reason"] != "exclusive_focus")
    before = F.coalesce(F.size(F.filter("base_test.skip_markers", lambda m: m["reason"] != "exclusive_focus")), F.lit(0))
    more = p.withColumn("real", real).where((F.size("real") > F.greatest(before, F.lit(0))) & ~F.col("added"))
    return _rows(more, "Test skipped", text("`", F.col("test_id"), "` gained a skip marker."), F.get(F.col("real"), F.size("real") - 1)["line"], "head")


@rule("VID004", "Tolerance loosened", severity="medium", penalty=15)
def loosened(context: Context) -> DataFrame:
    p = pairs(context).where("not removed and not added")

    def widest(test: str) -> Column:
        return F.array_max(F.transform(F.filter(f"{test}.assertions", lambda a: a["kind"] == "approximate"), lambda a: a["tolerance"]))

    def count(test: str, kind: str) -> Column:
        return F.size(F.filter(f"{test}.assertions", lambda a: a["kind"] == kind))

    rose = widest("head_test") > widest("base_test")
    became = (count("head_test", "approximate") > count("base_test", "approximate")) & (count("head_test", "equality") < count("base_test", "equality"))
    return _rows(p.where(F.coalesce(rose, F.lit(False)) | became), "Tolerance loosened", text("`", F.col("test_id"), "` accepts more than before."), F.col("head_test.line_start"), "head")


@rule("VID005", "Assertion weakened", severity="medium", penalty=15)
def weakened(context: Context) -> DataFrame:
    p = pairs(context).where("not removed and not added and strength_delta < 0 and head_n_assertions >= base_n_assertions")
    return _rows(p, "Assertion weakened", text("`", F.col("test_id"), "` lost strength ", (-F.col("strength_delta")).cast("string"), "."), F.col("head_test.line_start"), "head")


@rule("VID011", "Code added without assertions", severity="low", penalty=5)
def untested(context: Context) -> DataFrame:
    p = pairs(context)
    net = p.groupBy("cs_id").agg(F.sum(F.coalesce("head_n_assertions", F.lit(0)) - F.coalesce("base_n_assertions", F.lit(0))).alias("net"))
    code = context.lines.where("side = 'head'").join(growing(context.non_test_files().select("cs_id", "file_ord")), ["cs_id", "file_ord"], "left_semi")
    code = code.groupBy("cs_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file_ord", "line_ord", "path", "line_no", "text")).alias("first"))
    rows = code.join(growing(net), "cs_id", "left").where(F.coalesce("net", F.lit(0)) <= 0)
    first = F.col("first")
    return rows.select("cs_id", first["file_ord"].alias("file_ord"), first["path"].alias("path"), F.lit("Code added without new assertions").alias("title"), text(F.col("n").cast("string"), " line(s) of code were added with no net new assertion.").alias("detail"), F.array(evidence(first["line_no"], "head", first["text"], first["path"])).alias("evidence"), F.lit(0).alias("check_ord"), F.lit(0).alias("line_ord"))


@rule("VID012", "Retry added", severity="medium", penalty=10)
def retried(context: Context) -> DataFrame:
    p = pairs(context).where("not removed")
    more = p.where(F.size("head_test.retries") > F.greatest(F.coalesce(F.size("base_test.retries"), F.lit(0)), F.lit(0)))
    return _rows(more, "Retry added", text("`", F.col("test_id"), "` is now retried."), F.get(F.col("head_test.retries"), F.lit(0))["line"], "head")


def aligned(context: Context) -> DataFrame:
    """Aligned assertions that differ, made once for the rules that read them."""
    return context.once("aligned", lambda: aligned_assertions(pairs(context)))


def changed_code(context: Context) -> DataFrame:
    """(cs_id, file_ord, path) of files that aren't tests, in a language that is known, with a changed line."""
    code = context.non_test_files().where(detect_language(F.col("path")).isNotNull()).select(*KEYS)
    return code.join(growing(context.lines.select(*KEYS).distinct()), [*KEYS], "left_semi")


def _values(assertion: str) -> Column:
    """The operands that are written out as values."""
    return F.array_join(F.filter(f"{assertion}.operands", lambda x, i: F.get(F.col(f"{assertion}.literal"), i)), ", ")


@rule("VID006", "Expected literal edited", severity="high", penalty=20)
def literal_edited(context: Context) -> DataFrame:
    """An assertion expects another value of the same expression, and code changes with it. Tolerances are VID004's."""
    about = F.exists("now.literal", lambda x: ~x)
    same = expectation(F.col("was")) == expectation(F.col("now"))
    edited = aligned(context).where(same & about & F.col("was.tolerance").eqNullSafe(F.col("now.tolerance")) & (F.col("was.operands") != F.col("now.operands")))
    rows = edited.join(growing(changed_code(context).select("cs_id")), "cs_id", "left_semi")
    both = F.array(evidence(F.col("was.line"), "base", F.array_join("was.operands", " | ")), evidence(F.col("now.line"), "head", F.array_join("now.operands", " | ")))
    detail = text("`", F.col("test_id"), "` expected `", _values("was"), "`, now `", _values("now"), "`, in a change that touches code too.")
    return rows.select(*KEYS, F.lit("Expected literal edited").alias("title"), detail.alias("detail"), both.alias("evidence"), F.lit(0).alias("check_ord"), F.col("ord").alias("line_ord"))


@rule("VID007", "Unit under test mocked", severity="high", penalty=20)
def unit_mocked(context: Context) -> DataFrame:
    """A test gains a mock of what another file of the change defines: the target is resolved through the test's own imports and through modules that hand names on."""
    p = pairs(context).where("not removed")
    had = F.coalesce(F.transform("base_test.mocks", lambda m: m["target"]), F.expr("cast(array() as array<string>)"))
    gained = p.select(*KEYS, "test_id", F.col("pair_ord.ord").alias("test_ord"), F.posexplode(F.filter("head_test.mocks", lambda m: (m["target"] != "") & ~F.array_contains(had, m["target"]))).alias("ord", "m"))
    gained = gained.select(*KEYS, "test_id", "test_ord", "ord", F.col("m.target").alias("target"), F.col("m.line").alias("line"))
    edges = context.once("imports", lambda: import_edges(context.files))
    parts = F.split("target", r"\.")
    # A target as it is written (no name), and by what its first name stands for: both in one pass over the gained ones.
    both = gained.withColumn("name", F.explode(F.array(F.lit(None).cast("string"), F.get(parts, F.lit(0)))))
    local = both.join(growing(edges.select(*KEYS, "name", "stands_for")), [*KEYS, "name"], "left").where("name is null or stands_for is not null")
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ".")
    stands = F.when(F.size(parts) > 1, F.concat_ws(".", "stands_for", rest)).otherwise(F.col("stands_for"))
    names = local.select(*gained.columns, F.when(F.col("name").isNull(), F.col("target")).otherwise(stands).alias("resolved"))
    code = changed_code(context).where(detect_language(F.col("path")) == "python").select("cs_id", F.explode(module_names(F.col("path"))).alias("module"), F.col("path").alias("code_path"))
    met = prefixes(handed_on(names, edges)).join(growing(code), ["cs_id", "module"])
    one = met.groupBy(*gained.columns).agg(F.min(F.struct("code_path", "resolved")).alias("c"))
    detail = text("`", F.col("test_id"), "` now replaces `", F.col("target"), "`, which is `", F.col("c.resolved"), "` of ", F.col("c.code_path"), ", changed here.")
    return one.select(*KEYS, F.lit("Unit under test mocked").alias("title"), detail.alias("detail"), F.array(evidence(F.col("line"), "head", F.col("target"))).alias("evidence"), F.col("test_ord").alias("check_ord"), F.col("ord").alias("line_ord"))


@rule("VID008", "Exception swallowed around an assertion", severity="high", penalty=20)
def swallowed(context: Context) -> DataFrame:
    """An assertion that could fail its test can't any more, for something around it takes the exception and goes on."""
    rows = aligned(context).where("not was.swallowed and now.swallowed")
    detail = text("`", F.col("test_id"), "` goes on when the assertion on `", F.array_join("now.operands", " | "), "` fails.")
    return rows.select(*KEYS, F.lit("Exception swallowed around an assertion").alias("title"), detail.alias("detail"), F.array(evidence(F.col("now.line"), "head", F.array_join("now.operands", " | "))).alias("evidence"), F.lit(0).alias("check_ord"), F.col("ord").alias("line_ord"))
