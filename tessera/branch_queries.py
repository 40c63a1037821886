"""Queries over tessera.plans.branches, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import GateConfig
from tessera.functions.lines import side_lines
from tessera.operators import exclusions, pairing
from tessera.operators.surfaces import extract_sources
from tessera.plans import branches as B
from tessera.plans.derived import table
from tessera.sources.unified_diff import read_diffs


def diff_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = read_diffs(B.sections(table(spark, d, "orders")))

    def n(side: str):
        return F.size(side_lines(F.col("hunks"), side)).cast("long")

    return rows.select("cs_id", "path", "kind", "base_path", "is_binary", F.when(F.col("hunks").isNotNull(), F.size("hunks").cast("long")).alias("n_hunks"), F.when(F.col("hunks").isNotNull(), n("head")).alias("n_added"), F.when(F.col("hunks").isNotNull(), n("base")).alias("n_removed"), "parse_error")


def class_surfaces(spark: SparkSession, d: str) -> DataFrame:
    rows = pairing.test_rows(extract_sources(B.class_sources(table(spark, d, "customer"))), "framework")
    t, a = F.col("test"), F.get("test.assertions", F.lit(0))
    return rows.select(
        "cs_id", "framework", "test_id", t["qualname"].alias("qualname"), t["line_start"].alias("line_start"), t["is_discoverable"].alias("is_discoverable"), "will_run", F.coalesce(a["kind"], F.lit("")).alias("kind"),
        F.coalesce(F.array_join(a["operands"], "|"), F.lit("")).alias("operands"), a["tolerance"].alias("tolerance"), F.array_join(F.transform(t["mocks"], lambda m: m["target"]), "|").alias("mocks"), F.array_join(t["exercised_symbols"], "|").alias("symbols"), "n_assertions",
    )


def repeated_test_ids(spark: SparkSession, d: str) -> DataFrame:
    return pairing.by_id(B.repeated_tests(table(spark, d, "lineitem"))).select("cs_id", "test_id", "test_ord", "part")


def vid010_tool_lists(spark: SparkSession, d: str) -> DataFrame:
    rows, e = exclusions.list_changes(B.tool_lists(table(spark, d, "customer")), GateConfig()), F.get("evidence", F.lit(0))
    return rows.select("cs_id", "path", "title", "detail", e["line"].alias("line"), e["side"].alias("side"), e["snippet"].alias("snippet"))


QUERIES = {f.__name__: f for f in (diff_sections, class_surfaces, repeated_test_ids, vid010_tool_lists)}


def _text(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + value.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"


def _digit(of: int, values: tuple) -> str:
    return "[" + ", ".join(_text(v) if isinstance(v, str | None) else str(v) for v in values) + f"][c_custkey // {of} % {len(values)} + 1]"


def _number(value) -> str:
    return "CAST(NULL AS BIGINT)" if value is None else f"CAST({value} AS BIGINT)"


_SECTIONS = ", ".join(
    f"({i}, {_text(s.path)}, {_text(s.kind)}, {_text(s.base_path)}, {'CAST(NULL AS BOOLEAN)' if s.binary is None else s.binary}, {_number(s.hunks)}, {_number(s.added)}, {_number(s.removed)}, {_text(s.error)})" for i, s in enumerate(B.SECTIONS)
)
_FILE = "'tests/test_k' || c_custkey || '.py'"
_LISTS = {c.key: c for c in exclusions.LISTS}


def _changed(parity: int, path: str, lists: tuple, first: int, step: int) -> str:
    """Items that came to or left each of the lists of one file."""
    parts = []
    for n, (key, letter, salt) in enumerate(lists):
        c = _LISTS[key]
        for name, m, test in B.ITEMS:
            was, now = f"(c_custkey + {salt}) % {m} <> 0", f"(c_custkey + {salt + 1}) % {m} <> 0"
            if c.added and not test:
                continue
            item = f"{letter}/{name}"
            parts.append(
                f"SELECT c_custkey AS cs_id, '{path}' AS path, {_text(c.title)} AS title, {_text(c.before_item + item + c.after_item + path + c.end)} AS detail, CAST({first + n * step} AS INTEGER) AS line, '{'head' if c.added else 'base'}' AS side, '{item}' AS snippet "
                f"FROM customer WHERE c_custkey % 2 = {parity} AND {now if c.added else was} AND NOT ({was if c.added else now})"
            )
    return " UNION ALL ".join(parts)


ORACLES = {
    "diff_sections": f"""
      WITH s(i, path, kind, base_path, is_binary, n_hunks, n_added, n_removed, parse_error) AS (VALUES {_SECTIONS})
      SELECT o_orderkey AS cs_id, replace(path, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS path, kind, replace(base_path, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS base_path, is_binary, n_hunks, n_added, n_removed,
        replace(parse_error, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS parse_error
      FROM orders JOIN s ON i = o_orderkey % {len(B.SECTIONS)}""",
    "class_surfaces": f"""
      WITH c AS (
        SELECT *, {_digit(1, B.CLASSES)} AS class, {_digit(3, B.BASES)} AS base, {_digit(9, B.METHODS)} AS method, c_custkey // 36 % 5 AS body, {_digit(36, tuple(b[1] for b in B.BODIES))} AS kind,
          replace({_digit(36, tuple(b[2] for b in B.BODIES))}, '{{k}}', CAST(c_custkey AS VARCHAR)) AS operands, {_digit(36, tuple('NULL' if b[3] is None else b[3] for b in B.BODIES)).replace("'NULL'", 'NULL')} AS tolerance,
          replace({_digit(36, tuple(b[4] for b in B.BODIES))}, '{{k}}', CAST(c_custkey AS VARCHAR)) AS mocks, {_digit(36, tuple(b[5] for b in B.BODIES))} AS symbols
        FROM customer
      ),
      g AS (SELECT *, (starts_with(class, 'Test') OR base = '(unittest.TestCase)') AND starts_with(ltrim(method, '_'), 'test') AS seen FROM c),
      f AS (SELECT *, CASE WHEN seen AND body = 2 THEN 'pytest' WHEN base = '(unittest.TestCase)' OR (seen AND body IN (0, 1, 3)) THEN 'unittest' ELSE 'pytest' END AS framework FROM g)
      SELECT c_custkey AS cs_id, framework, {_FILE} || '::test_top' AS test_id, 'test_top' AS qualname, 4 AS line_start, true AS is_discoverable, true AS will_run, '' AS kind, '' AS operands, CAST(NULL AS DOUBLE) AS tolerance, '' AS mocks, 'load' AS symbols, CAST(0 AS BIGINT) AS n_assertions FROM f
      UNION ALL
      SELECT c_custkey, framework, {_FILE} || '::' || class || '::' || method, class || '.' || method, 9, starts_with(method, 'test_'), starts_with(method, 'test_') AND c_custkey % 2 = 0, kind, operands, tolerance, mocks, symbols, CAST(body <> 4 AS BIGINT) FROM f WHERE seen""",
    "repeated_test_ids": """
      WITH t AS (SELECT l_orderkey AS cs_id, 't' || l_partkey % 2 AS test_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS o FROM lineitem)
      SELECT cs_id, test_id, CAST(min(o) AS INTEGER) AS test_ord, arg_max(l_partkey, o) AS part FROM t GROUP BY cs_id, test_id""",
    "vid010_tool_lists": f"{_changed(0, 'jest.config.js', B.JS_LISTS, 2, 1)} UNION ALL {_changed(1, '.coveragerc', B.COVERAGE_LISTS, 3, 3)}",
}
