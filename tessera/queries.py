"""Queries of the engine's own operators over tables derived in tessera.plans.derived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import branch_queries
from tessera.config import GateConfig, RuleSetting
from tessera.functions import lines as L
from tessera.functions.listvalues import list_values, token_array
from tessera.functions.paths import detect_language, is_test_path, looks_test_related, matches_any, normalized
from tessera.operators import ci_thresholds, exclusions, findings, pairing, rules
from tessera.operators.surfaces import capture_rows, extract_sources
from tessera.operators.surfaces import surfaces as surfaces_of
from tessera.plans import derived
from tessera.plans.gate import gate
from tessera.sources.git import attach_blobs, split_messages
from tessera.sources.pairs import from_pairs
from tessera.sources.unified_diff import read_diffs

CONFIG = GateConfig()


def _orders(spark, d):
    return derived.table(spark, d, "orders")


def _found(rows: DataFrame, rule_id: str = "VID009") -> DataFrame:
    """Findings flat: the first and last evidence as columns."""
    first, last = F.get("evidence", F.lit(0)), F.get("evidence", F.size("evidence") - 1)
    return rows.select("cs_id", "path", "title", "detail", first["line"].alias("first_line"), first["side"].alias("first_side"), first["snippet"].alias("first_snippet"), last["line"].alias("last_line"), last["side"].alias("last_side"), last["snippet"].alias("last_snippet"))


def _lines(files: DataFrame) -> DataFrame:
    return L.change_lines(files.where(~F.col("is_binary")))


def vid009_coverage_lowered(spark: SparkSession, d: str) -> DataFrame:
    return _found(ci_thresholds.coverage_lowered(derived.whole_files(derived.config_corpus(_orders(spark, d)))))


def vid009_timeout_raised(spark: SparkSession, d: str) -> DataFrame:
    return _found(ci_thresholds.timeout_raised(derived.whole_files(derived.config_corpus(_orders(spark, d)))))


def vid009_flags(spark: SparkSession, d: str) -> DataFrame:
    return _found(ci_thresholds.flags(derived.flag_corpus(_orders(spark, d))))


def vid009_strict_flip(spark: SparkSession, d: str) -> DataFrame:
    return _found(ci_thresholds.strict_flipped(derived.whole_files(derived.flag_corpus(_orders(spark, d)))))


def vid009_or_true(spark: SparkSession, d: str) -> DataFrame:
    return _found(ci_thresholds.or_true(derived.whole_files(derived.flag_corpus(_orders(spark, d)))))


def vid009_retry_window(spark: SparkSession, d: str) -> DataFrame:
    return _found(ci_thresholds.retries(derived.retry_corpus(_orders(spark, d))))


def vid010_ignore_flag(spark: SparkSession, d: str) -> DataFrame:
    return _found(exclusions.ignored_by_pytest(derived.whole_files(derived.flag_corpus(_orders(spark, d))), CONFIG))


def vid010_gitignore(spark: SparkSession, d: str) -> DataFrame:
    return _found(exclusions.git_ignored(derived.flag_corpus(_orders(spark, d)), CONFIG))


def vid010_list_changes(spark: SparkSession, d: str) -> DataFrame:
    return _found(exclusions.list_changes(derived.list_corpus(derived.table(spark, d, "customer")), CONFIG))


def vid010_list_items(spark: SparkSession, d: str) -> DataFrame:
    files = derived.list_corpus(derived.table(spark, d, "customer"))
    keys = ("norecursedirs", "testpaths", "collect_ignore", "omit")
    read = files.select("cs_id", F.explode(list_values(F.col("head_content"), keys)).alias("key", "items"))
    return read.select("cs_id", "key", F.array_join("items", "|").alias("items"), F.size("items").cast("long").alias("n"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """The token expression on the lines of list settings."""
    files = derived.list_corpus(derived.table(spark, d, "customer"))
    rows = L.file_lines(files, "head_content", "head")
    return rows.select("cs_id", "line_no", F.array_join(token_array(F.col("text")), "|").alias("tokens"))


def _findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = _orders(spark, d)
    done = gate(derived.order_changesets(orders).dropDuplicates(["cs_id"]), derived.gate_corpus(orders), CONFIG)
    return done.findings, done.scores


def findings_sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = findings.placed(_findings(spark, d)[0])
    return rows.select("cs_id", "rule_id", "severity", findings.severity_rank(F.col("severity")).alias("severity_rank"), "penalty", "title", findings.location(F.col("path"), F.col("evidence")).alias("location"), "place")


def justified_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = _findings(spark, d)[0].where(F.col("justification").isNotNull())
    return rows.select("cs_id", "rule_id", "title", "justification", findings.effective_penalty(F.col("penalty"), F.col("justification")).alias("effective_penalty"))


def trust_score(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d)[1].select("cs_id", "value", "threshold", "n_unjustified", "worst_severity", "passed", "band", "summary")


def score_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands and texts of values from 0 to 100 that orders give, by threshold."""
    k = F.col("o_orderkey")
    values = _orders(spark, d).select(k.alias("cs_id"), (k % 101).cast("int").alias("value"), F.get(F.array(*map(F.lit, (70, 95, 30))), (F.col("o_custkey") % 3).cast("int")).alias("threshold"))
    b = findings.band(F.col("value"), F.col("threshold"))
    return values.select("cs_id", "value", "threshold", b.alias("band"), (F.col("value") >= F.col("threshold")).alias("passed"), findings.summary(F.col("value"), b, F.col("value") % 3).alias("summary"))


def rule_overrides(spark: SparkSession, d: str) -> DataFrame:
    """A disabled rule is absent; an override of severity and a penalty of 0 hold."""
    files = derived.whole_files(derived.flag_corpus(_orders(spark, d)))
    config = GateConfig(rules={"VID009": RuleSetting(severity="low", penalty=0), "VID010": RuleSetting(enabled=False)})
    return gate(derived.changesets(files), files, config).findings.groupBy("rule_id", "severity", "penalty").agg(F.count(F.lit(1)).alias("n"))


def glob_match_test_paths(spark: SparkSession, d: str) -> DataFrame:
    files = derived.text_corpus(derived.table(spark, d, "documents"))
    config = GateConfig(ignore_globs=("src1/**",))
    p = F.col("path")
    return files.select("cs_id", "path", is_test_path(p, config).alias("is_test"), matches_any(p, ("src?/*/test_[1-4]*.py",)).alias("set_match"), looks_test_related(F.concat(F.lit("x/"), "path"), config).alias("related"), normalized(F.concat(F.lit(".\\"), p)).alias("normalized"))


def detect_languages(spark: SparkSession, d: str) -> DataFrame:
    files = derived.text_corpus(derived.table(spark, d, "documents"))
    return files.select("cs_id", "path", detect_language(F.col("path")).alias("language"))


def test_file_split(spark: SparkSession, d: str) -> DataFrame:
    files = derived.text_corpus(derived.table(spark, d, "documents")).withColumn("hunks", F.lit(None))
    context = rules.Context(files, GateConfig(ignore_globs=("src2/**",)))
    return context.test_files().select("cs_id", "path", F.lit(True).alias("is_test")).unionByName(context.non_test_files().select("cs_id", "path", F.lit(False).alias("is_test")))


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = L.file_lines(derived.text_corpus(derived.table(spark, d, "documents")), "head_content", "head")
    return rows.select("cs_id", "line_no", "text")


def nth_line(spark: SparkSession, d: str) -> DataFrame:
    docs = derived.table(spark, d, "documents")
    n = (F.col("doc_id") % 6).cast("int") - 1
    return docs.select("doc_id", n.alias("n"), L.nth_line(F.col("text"), n).alias("line"))


def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(derived.config_corpus(_orders(spark, d))).select("cs_id", "path", "side", "line_ord", "line_no", "text")


def changed_text(spark: SparkSession, d: str) -> DataFrame:
    files = derived.config_corpus(_orders(spark, d))
    return files.select("cs_id", L.joined(L.side_lines(F.col("hunks"), "head")).alias("added_text"), L.joined(L.side_lines(F.col("hunks"), "base")).alias("removed_text"))


def change_lookup(spark: SparkSession, d: str) -> DataFrame:
    """by_path and matching over change sets of several files."""
    o = _orders(spark, d)
    files = derived.config_corpus(o).withColumn("cs_id", F.col("cs_id") % 500).withColumn("file_ord", F.col("hunks")[0]["base_start"])
    files = files.withColumn("kind", F.when(F.col("file_ord") % 3 == 0, "added").otherwise("modified")).select("cs_id", "file_ord", "path", "kind").distinct()
    return L.matching(L.by_path(files, "pyproject.toml"), "added").select("cs_id", "file_ord", "path", "kind")


def hunks_from_pair(spark: SparkSession, d: str) -> DataFrame:
    files = from_pairs(derived.text_corpus(derived.table(spark, d, "documents")))
    return files.select("cs_id", F.size(L.side_lines(F.col("hunks"), "base")).cast("long").alias("n_removed"), F.size(L.side_lines(F.col("hunks"), "head")).cast("long").alias("n_added"))


def parse_unified_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = read_diffs(derived.diff_texts(_orders(spark, d)))
    h = F.get("hunks", F.lit(0))
    return rows.select("cs_id", "path", "kind", h["base_start"].alias("base_start"), h["head_lines"].alias("head_lines"), F.get(h["added"], F.lit(0))["line"].alias("line_no"), F.get(h["added"], F.lit(0))["text"].alias("added"), F.get(h["removed"], F.lit(0))["text"].alias("removed"), F.col("parse_error").isNotNull().alias("failed"))


def blob_attach(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    k = F.col("o_orderkey")
    files = o.select(k.alias("cs_id"), F.lit(0).alias("file_ord"), F.concat(F.lit("f"), (k % 50).cast("string")).alias("path"), F.get(F.array(*map(F.lit, ("added", "modified", "deleted", "renamed"))), (k % 4).cast("int")).alias("kind"), F.when(k % 4 == 3, F.concat(F.lit("g"), (k % 50).cast("string"))).alias("base_path"), (k % 10 == 9).alias("is_binary"), F.lit(None).cast("string").alias("hunks"))
    sets = files.select("cs_id", F.concat(F.lit("r"), (F.col("cs_id") % 3).cast("string")).alias("base_ref"), F.concat(F.lit("r"), (F.col("cs_id") % 3 + 1).cast("string")).alias("head_ref"))
    names = spark.range(50).select(F.explode(F.array(F.concat(F.lit("f"), F.col("id").cast("string")), F.concat(F.lit("g"), F.col("id").cast("string")))).alias("path"))
    blobs = names.select(F.explode(F.array(*[F.lit(f"r{i}") for i in range(4)])).alias("ref"), "path").select("ref", "path", F.concat_ws("@", "path", "ref").alias("content")).where("path <> 'f7'")
    return attach_blobs(files, sets, blobs).select("cs_id", "path", "kind", "base_content", "head_content")


def commit_messages(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    raw = F.concat(F.lit(" first "), F.col("o_orderkey").cast("string"), F.lit("\n\x00\n\x00\nsecond "), F.col("o_orderpriority"), F.lit("\n\x00"))
    return o.select(F.col("o_orderkey").alias("cs_id"), F.posexplode(split_messages(raw)).alias("ord", "message"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_tests(pairing.test_rows(derived.surface_corpus(derived.table(spark, d, "lineitem"))))


def pair_tests(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("cs_id", "test_id", "removed", "added", F.coalesce("base_strength", F.lit(0)).alias("base_strength"), F.coalesce("head_strength", F.lit(0)).alias("head_strength"), "strength_delta")


def removed_tests(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("removed").select("cs_id", "test_id")


def added_tests(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("added").select("cs_id", "test_id")


def surface_strength(spark: SparkSession, d: str) -> DataFrame:
    rows = pairing.test_rows(derived.surface_corpus(derived.table(spark, d, "lineitem")))
    return pairing.surface_totals(rows).select("cs_id", "side", "n_tests", "n_running", "n_assertions", "strength")


def assertion_signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = pairing.test_rows(derived.surface_corpus(derived.table(spark, d, "lineitem")))
    each = rows.select("cs_id", "side", F.explode("test.assertions").alias("a"))
    return each.groupBy(pairing.signature(F.col("a")).alias("signature"), "side").agg(F.count(F.lit(1)).alias("n"), F.max(pairing.strength(F.col("a.kind"))).cast("long").alias("strength"))


def extract_surface(spark: SparkSession, d: str) -> DataFrame:
    rows = pairing.test_rows(extract_sources(derived.source_texts(derived.table(spark, d, "customer"))))
    a = F.get("test.assertions", F.lit(0))
    return rows.select("cs_id", "test_id", "will_run", "n_assertions", "strength", F.col("test.line_start").alias("line_start"), F.col("test.line_end").alias("line_end"), a["kind"].alias("first_kind"), F.array_join(a["operands"], "|").alias("first_operands"), F.array_join("test.exercised_symbols", "|").alias("symbols"))


def surface_states(spark: SparkSession, d: str) -> DataFrame:
    """The states of both sides of derived text files."""
    files = from_pairs(derived.text_corpus(derived.table(spark, d, "documents")))
    kind = F.when(F.col("cs_id") % 12 == 0, "added").when(F.col("cs_id") % 18 == 6, "deleted").otherwise("modified")
    files = files.withColumn("kind", kind).withColumn("base_content", F.when((F.col("kind") != "added") & (F.col("cs_id") % 5 != 0), F.lit("def test_a():\n    assert 1\n"))).withColumn("head_content", F.when(F.col("kind") != "deleted", F.lit("def test_a(:\n")))
    return surfaces_of(files, CONFIG).select("cs_id", "side", "status", "parse_ok")


def _lost(spark: SparkSession, d: str, rule_id: str) -> DataFrame:
    """What one rule on tests finds in derived test modules."""
    files = derived.module_pairs(derived.table(spark, d, "customer"))
    e = F.get("evidence", F.lit(0))
    rows = gate(derived.changesets(files), files, CONFIG, rules=(rule_id,), keep=False).findings
    return rows.select("cs_id", "rule_id", "severity", "penalty", "title", "detail", "path", e["line"].alias("line"), e["side"].alias("side"), e["snippet"].alias("snippet"))


def vid001_test_removed(spark: SparkSession, d: str) -> DataFrame:
    return _lost(spark, d, "VID001")


def vid002_assertion_removed(spark: SparkSession, d: str) -> DataFrame:
    return _lost(spark, d, "VID002")


def vid003_test_skipped(spark: SparkSession, d: str) -> DataFrame:
    return _lost(spark, d, "VID003")


def vid004_tolerance_loosened(spark: SparkSession, d: str) -> DataFrame:
    return _lost(spark, d, "VID004")


def vid005_assertion_weakened(spark: SparkSession, d: str) -> DataFrame:
    return _lost(spark, d, "VID005")


def vid011_untested_code(spark: SparkSession, d: str) -> DataFrame:
    return _lost(spark, d, "VID011")


def vid012_retry_added(spark: SparkSession, d: str) -> DataFrame:
    return _lost(spark, d, "VID012")


def _found_by(files: DataFrame, rule_id: str) -> DataFrame:
    """What one rule finds in files with both contents; nothing is kept."""
    rows = gate(derived.changesets(files), files, CONFIG, rules=(rule_id,), keep=False).findings
    return _found(rows).withColumn("rule_id", F.lit(rule_id))


def vid006_literal_edited(spark: SparkSession, d: str) -> DataFrame:
    return _found_by(derived.expectation_pairs(derived.table(spark, d, "customer")), "VID006")


def vid007_unit_mocked(spark: SparkSession, d: str) -> DataFrame:
    return _found_by(derived.mock_pairs(derived.table(spark, d, "customer")), "VID007")


def vid008_exception_swallowed(spark: SparkSession, d: str) -> DataFrame:
    return _found_by(derived.handler_pairs(derived.table(spark, d, "customer")), "VID008")


def captures(spark: SparkSession, d: str) -> DataFrame:
    return capture_rows(derived.source_texts(derived.table(spark, d, "customer")), "Call").select("cs_id", "text", "line")


def gate_over_orders(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: derived configuration changes through scope, lines, both rules, trailers and scores, counted by band."""
    done = _findings(spark, d)[1]
    return done.groupBy("band", "worst_severity").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


QUERIES = {
    f.__name__: f
    for f in (
        gate_over_orders, vid009_coverage_lowered, vid009_timeout_raised, vid009_flags, vid009_strict_flip, vid009_or_true, vid009_retry_window,
        vid010_ignore_flag, vid010_gitignore, vid010_list_changes, vid010_list_items, tokens, findings_sorted, justified_findings, trust_score, score_bands, rule_overrides,
        glob_match_test_paths, detect_languages, test_file_split, file_lines, nth_line, changed_lines, changed_text, change_lookup, hunks_from_pair, parse_unified_diff,
        vid001_test_removed, vid002_assertion_removed, vid003_test_skipped, vid004_tolerance_loosened, vid005_assertion_weakened, vid011_untested_code, vid012_retry_added, vid006_literal_edited, vid007_unit_mocked, vid008_exception_swallowed,
        blob_attach, commit_messages, pair_tests, removed_tests, added_tests, surface_strength, assertion_signatures, extract_surface, surface_states, captures,
    )
} | branch_queries.QUERIES
