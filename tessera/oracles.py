"""DuckDB SQL that repeats the queries on the same tables, from the derivations up."""

from __future__ import annotations

from tessera import branch_queries
from tessera.plans.derived import ENDINGS, HANDLERS, PATHS
from tessera.schemas import STRENGTH

_PATHS = "[" + ", ".join(f"'{p}'" for p in PATHS) + "]"
_KINDS = "[" + ", ".join(f"'{k}'" for k in STRENGTH) + "]"
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STRENGTH.items()) + " END"
_SCOPE = r"^(\.github/workflows/[^/]*\.ya?ml|pyproject\.toml|setup\.cfg|tox\.ini|\.coveragerc|pytest\.ini|mypy\.ini|jest\.config\.[^/]*|vitest\.config\.[^/]*|package\.json|Makefile|\.pre-commit-config\.yaml)$"
_TESTS = (
    r"^(?:(?:[^/]+/)*test_[^/]*\.py|(?:[^/]+/)*[^/]*_test\.py|(?:[^/]+/)*tests/(?:[^/]+/)*[^/]*\.py|(?:[^/]+/)*[^/]*\.(?:test|spec)\.(?:ts|tsx|js|jsx)|(?:[^/]+/)*__tests__/(?:[^/]+/)*[^/]*\.(?:ts|js))$"
)

#: What ends a line, CR LF as one.
BREAKS_SQL = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"

# One row for each changed line: cs_id, path, side, line_ord, line_no, text.
CONFIG_LINES = f"""
o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) % 100 AS base FROM orders),
v AS (SELECT *, (base * 7 + c) % 100 AS head, {_PATHS}[k % 16 + 1] AS path, c % 40 + 1 AS pos FROM o),
e AS (
  SELECT k, path, 'base' AS side, 0 AS ord, pos, base AS v FROM v UNION ALL SELECT k, path, 'head', 0, pos, head FROM v
  UNION ALL SELECT k, path, 'base', 1, pos + 1, base + 1 FROM v WHERE k % 11 = 0 UNION ALL SELECT k, path, 'head', 1, pos + 1, head + 1 FROM v WHERE k % 11 = 0
),
config_lines AS (
  SELECT k AS cs_id, 0 AS file_ord, path, side, ord AS line_ord, CAST(pos AS INTEGER) AS line_no,
    CASE k % 7 WHEN 0 THEN 'fail_under = ' || v WHEN 1 THEN 'addopts = --cov-fail-under=' || v WHEN 2 THEN '  lines: ' || v || ',' WHEN 3 THEN '    timeout-minutes: ' || v
      WHEN 4 THEN 'run: pytest --timeout=' || v WHEN 5 THEN '  testTimeout: ' || v || '000' ELSE 'Fail-Under: ' || v || '.5' END AS text
  FROM e
)"""

FLAG_LINES = f"""
fo AS (SELECT o_orderkey AS k, (o_custkey + o_orderkey) % 12 AS s, ' job' || o_orderkey % 5 AS tail, CAST(o_orderkey % 9 AS VARCHAR) AS n FROM orders),
ft AS (
  SELECT *, CASE s WHEN 9 THEN 'strict = true' WHEN 10 THEN 'strict = False' ELSE '  make check' || tail END AS was,
    CASE s WHEN 0 THEN 'git commit --no-verify' || tail WHEN 1 THEN 'HUSKY=0 git push --no-validate' || tail WHEN 2 THEN 'flake8 --exit-zero' || tail WHEN 3 THEN 'continue-on-error: TRUE'
      WHEN 4 THEN '  make check' || tail || ' || true' WHEN 5 THEN 'make other' || tail || ' || true' WHEN 6 THEN '--ignore=tests/unit/t' || n WHEN 7 THEN 'addopts = --ignore=build --ignore=spec/x' || n
      WHEN 8 THEN 'pkg/tests/test_' || n || '.py' WHEN 9 THEN '  STRICT = false' WHEN 10 THEN 'strict = true' ELSE '# note' || tail END AS now,
    CASE WHEN s IN (6, 7) THEN ['pytest.ini', 'tox.ini', 'a/b/conftest.py', 'other.txt'][k % 4 + 1] WHEN s = 8 THEN ['.gitignore', 'pkg/.gitignore', 'notes.txt'][k % 3 + 1] ELSE {_PATHS}[k % 16 + 1] END AS path
  FROM fo
),
flag_lines AS (
  SELECT k AS cs_id, 1 AS file_ord, path, 'base' AS side, 0 AS line_ord, CAST(k % 30 + 1 AS INTEGER) AS line_no, was AS text FROM ft
  UNION ALL SELECT k, 1, path, 'head', 0, CAST(k % 30 + 1 AS INTEGER), now FROM ft
)"""

# Findings of VID009 and VID010 on lines, as title, detail, both evidences.
def _numeric(name: str, lines: str) -> str:
    number = r"(\d+(?:\.\d+)?)"
    checks = (
        (0, "fail_under", rf"(?i)(?:^|[^-\w])fail[-_]under\s*[:=]\s*{number}", "''", 1), (1, "--cov-fail-under", rf"--cov-fail-under[= ]{number}", "''", 1),
        (2, "coverageThreshold", rf"(branches|functions|lines|statements)\s*:\s*{number}", r"regexp_extract(text, '(branches|functions|lines|statements)\s*:', 1)", 2),
        (30, "timeout-minutes", rf"\btimeout-minutes\s*:\s*{number}", "''", 1), (31, "--timeout", rf"--timeout[= ]{number}", "''", 1), (32, "testTimeout", rf"\btestTimeout\s*:\s*{number}", "''", 1),
    )
    rows = " UNION ALL ".join(f"SELECT *, {n} AS chk, '{label}' AS label, {key} AS key, CAST(regexp_extract(text, '{p}', {g}) AS DOUBLE) AS value FROM {lines} WHERE regexp_matches(path, '{_SCOPE}') AND regexp_matches(text, '{p}')" for n, label, p, key, g in checks)
    return f"""
{name}_s AS ({rows}),
{name}_p AS (
  SELECT cs_id, file_ord, path, chk, label, key, max(CASE side WHEN 'base' THEN value END) AS b, max(CASE side WHEN 'head' THEN value END) AS h,
    max(CASE side WHEN 'base' THEN line_no END) AS bl, max(CASE side WHEN 'head' THEN line_no END) AS hl, max(CASE side WHEN 'base' THEN trim(text) END) AS bt, max(CASE side WHEN 'head' THEN trim(text) END) AS ht
  FROM {name}_s GROUP BY ALL HAVING count(*) FILTER (WHERE side = 'base') = 1 AND count(*) FILTER (WHERE side = 'head') = 1
)"""


_FMT = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_FLAT = "cs_id, path, title, detail, CAST(bl AS INTEGER) AS first_line, {0} AS first_side, bt AS first_snippet, CAST(hl AS INTEGER) AS last_line, {1} AS last_side, ht AS last_snippet"
_TWO = _FLAT.format("'base'", "'head'")
_ONE = _FLAT.format("'head'", "'head'")


def _lowered(name: str) -> str:
    return f"""SELECT cs_id, file_ord, path, 'Coverage threshold lowered' AS title, '`' || label || '` dropped from ' || {_FMT.format('b')} || ' to ' || {_FMT.format('h')} || ' in ' || path || '.' AS detail, bl, bt, hl, ht FROM {name}_p WHERE chk < 30 AND h < b"""


def _raised(name: str) -> str:
    return f"""SELECT cs_id, file_ord, path, 'Test timeout raised substantially' AS title, '`' || label || '` rose from ' || {_FMT.format('b')} || ' to ' || {_FMT.format('h')} || ' in ' || path || ', more than 2x.' AS detail, bl, bt, hl, ht FROM {name}_p WHERE chk >= 30 AND b > 0 AND h >= 2 * b"""


_IN_SCOPE = f"regexp_matches(path, '{_SCOPE}')"
_HEAD = "line_no AS bl, trim(text) AS bt, line_no AS hl, trim(text) AS ht"
_FLAGS = " UNION ALL ".join(
    f"SELECT cs_id, file_ord, path, {title} AS title, {detail} AS detail, {_HEAD} FROM flag_lines WHERE side = 'head' AND {_IN_SCOPE} AND {where}"
    for title, detail, where in (
        ("'`continue-on-error: true` added'", "'A step or job in ' || path || ' was allowed to fail without failing the workflow.'", r"regexp_matches(path, '^\.github/workflows/[^/]*\.ya?ml$') AND regexp_matches(text, '(?i)\bcontinue-on-error\s*:\s*true\b')"),
        ("'`--no-verify` added to a command'", "'`--no-verify` skips a verification hook in ' || path || '.'", r"regexp_matches(text, '--no-verify\b')"),
        ("'`--no-validate` added to a command'", "'`--no-validate` skips a verification hook in ' || path || '.'", r"regexp_matches(text, '--no-validate\b')"),
        ("'`HUSKY=0` added to a command'", "'`HUSKY=0` skips a verification hook in ' || path || '.'", r"regexp_matches(text, '\bHUSKY=0\b')"),
        ("'`--exit-zero` added to a linter invocation'", "'A linter in ' || path || ' can no longer fail the build.'", r"regexp_matches(text, '--exit-zero\b')"),
    )
)
_STRICT = rf"""
SELECT cs_id, file_ord, path, 'mypy `strict` downgraded' AS title, '`strict = true` became `strict = false` in ' || path || '.' AS detail, min(CASE WHEN side = 'base' THEN line_no END) AS bl, 'strict = true' AS bt,
  max(CASE WHEN side = 'head' THEN line_no END) AS hl, max(CASE WHEN side = 'head' THEN trim(text) END) AS ht
FROM flag_lines WHERE {_IN_SCOPE} AND (side = 'base' AND regexp_matches(text, '(?i)^\s*strict\s*=\s*true\s*$') OR side = 'head' AND regexp_matches(text, '(?i)^\s*strict\s*=\s*false\s*$'))
GROUP BY cs_id, file_ord, path HAVING count(*) FILTER (WHERE side = 'base') >= 1 AND count(*) FILTER (WHERE side = 'head') = 1"""
_OR_TRUE = rf"""
SELECT cs_id, file_ord, path, '`|| true` appended to a check command' AS title, 'A previously-failing command in ' || path || ' can no longer fail the build.' AS detail, {_HEAD} FROM flag_lines a
WHERE side = 'head' AND {_IN_SCOPE} AND regexp_matches(trim(text), '^.*\S\s*\|\|\s*true\s*$')
  AND EXISTS (SELECT 1 FROM flag_lines b WHERE b.side = 'base' AND b.cs_id = a.cs_id AND b.path = a.path AND trim(b.text) = trim(regexp_extract(trim(a.text), '^(.*\S)\s*\|\|\s*true\s*$', 1)))"""
_IGNORED = rf"""
SELECT cs_id, file_ord, path, 'Test path newly ignored by pytest' AS title, '`--ignore=' || item || '` was added in ' || path || '.' AS detail, {_HEAD}
FROM (SELECT *, unnest(regexp_extract_all(text, '--ignore=(\S+)', 1)) AS item FROM flag_lines WHERE side = 'head' AND regexp_matches(path, '^(?:pyproject\.toml|setup\.cfg|tox\.ini|pytest\.ini|(?:[^/]+/)*conftest\.py)$')) a
WHERE NOT EXISTS (SELECT 1 FROM flag_lines b WHERE b.side = 'base' AND b.cs_id = a.cs_id AND contains(b.text, '--ignore=' || a.item)) AND (contains(lower(item), 'test') OR contains(lower(item), 'spec') OR regexp_matches(item, '{_TESTS}'))"""
_GITIGNORE = rf"""
SELECT cs_id, file_ord, path, 'Test path added to `.gitignore`' AS title, '`' || trim(text) || '` was added to ' || path || ' and matches the test globs.' AS detail, {_HEAD}
FROM flag_lines WHERE side = 'head' AND regexp_matches(path, '^(?:[^/]+/)*\.gitignore$') AND trim(text) <> '' AND NOT starts_with(trim(text), '#') AND regexp_matches(trim(text), '{_TESTS}')"""

_CONFIG_NUMERIC = f"{CONFIG_LINES}, {_numeric('c', 'config_lines')}"
# Everything that the gate finds on both corpora.
FINDINGS = f"""
{_CONFIG_NUMERIC}, {FLAG_LINES}, {_numeric('f', 'flag_lines')},
found AS (
  SELECT 'VID009' AS rule_id, * FROM ({_lowered('c')} UNION ALL {_raised('c')} UNION ALL {_lowered('f')} UNION ALL {_raised('f')} UNION ALL {_FLAGS} UNION ALL {_STRICT} UNION ALL {_OR_TRUE})
  UNION ALL SELECT 'VID010', * FROM ({_IGNORED} UNION ALL {_GITIGNORE})
),
judged AS (SELECT *, CASE WHEN cs_id % 9 = 0 AND rule_id = 'VID009' THEN 'ticket ' || cs_id END AS justification FROM found),
score AS (
  SELECT o.cs_id, CAST(greatest(0, 100 - coalesce(20 * count(j.rule_id) FILTER (WHERE justification IS NULL), 0)) AS INTEGER) AS value, count(j.rule_id) FILTER (WHERE justification IS NULL) AS n
  FROM (SELECT DISTINCT o_orderkey AS cs_id FROM orders) o LEFT JOIN judged j USING (cs_id) GROUP BY o.cs_id
),
band AS (SELECT *, CASE WHEN value >= 90 THEN 'trusted' WHEN value >= 70 THEN 'acceptable' WHEN value >= 40 THEN 'suspect' ELSE 'untrusted' END AS band, CASE WHEN n > 0 THEN 'high' END AS worst_severity FROM score)"""

_SUMMARY = "'Trust ' || value || '/100 (' || band || ') — ' || CASE WHEN n = 0 THEN 'no verification loss detected' WHEN n = 1 THEN '1 unjustified finding' ELSE n || ' unjustified findings' END"

_SURFACE = f"""
s AS (
  SELECT l_orderkey AS cs_id, l_linenumber AS t, 'base' AS side, {_KINDS}[l_partkey % 13 + 1] AS kind, l_partkey, l_suppkey, l_linestatus FROM lineitem WHERE l_returnflag <> 'A' OR l_suppkey % 7 <> 0
  UNION ALL SELECT l_orderkey, l_linenumber, 'head', {_KINDS}[CASE WHEN l_suppkey % 5 = 0 THEN (l_partkey % 13 + 3) % 13 ELSE l_partkey % 13 END + 1], l_partkey, l_suppkey, l_linestatus FROM lineitem WHERE l_returnflag <> 'R'
),
t AS (SELECT cs_id, side, 'tests/test_o' || cs_id || '.py::test_l' || t AS test_id, count(*) AS n, sum({_RANK}) AS strength, NOT bool_or(l_linestatus = 'F' AND t % 3 = 0) AS runs FROM s GROUP BY cs_id, side, t),
p AS (SELECT cs_id, test_id, NOT bool_or(side = 'head') AS removed, NOT bool_or(side = 'base') AS added, CAST(coalesce(max(strength) FILTER (WHERE side = 'base'), 0) AS BIGINT) AS base_strength, CAST(coalesce(max(strength) FILTER (WHERE side = 'head'), 0) AS BIGINT) AS head_strength
  FROM t GROUP BY cs_id, test_id)"""

_TEXT = """
d AS (SELECT doc_id, text, source || '/' || lang || '/test_' || doc_id || ['.py', '.ts', '.js', '.txt', '.pyi', '.spec.tsx'][doc_id % 6 + 1] AS path, regexp_split_to_array(text, chr(10)) AS parts FROM documents),
w AS (SELECT *, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines FROM d),
x AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n, len(lines) AS total FROM w)"""

_LIST_CONTENT = """
li AS (SELECT c_custkey AS k, salt, list_filter([CASE WHEN (c_custkey + salt) % 2 <> 0 THEN 'tests/a' END, CASE WHEN (c_custkey + salt) % 3 <> 0 THEN 'build' END, CASE WHEN (c_custkey + salt) % 5 <> 0 THEN 'spec_b' END, CASE WHEN (c_custkey + salt) % 7 <> 0 THEN 'lib/test_c.py' END], lambda z: z IS NOT NULL) AS items,
  CASE WHEN (c_custkey + salt) % 4 <> 0 THEN ['tests/x', 'tests/y'] ELSE ['tests/x'] END AS ci, c_custkey % 13 = salt AS broken FROM customer, (VALUES (0), (1)) v(salt)),
lb AS (SELECT * FROM li WHERE salt = 0), lh AS (SELECT * FROM li WHERE salt = 1)"""

def _lost(rule_id: str, severity: str, penalty: int, title: str, detail: str, line: int, side: str, shapes: str) -> str:
    """One finding for each customer whose module changes in one of these ways."""
    return f"""
      SELECT c_custkey AS cs_id, '{rule_id}' AS rule_id, '{severity}' AS severity, {penalty} AS penalty, '{title}' AS title, '`' || t || '` {detail}' AS detail, p AS path, {line} + CASE WHEN c_custkey % 12 IN (3, 7, 10) AND '{side}' = 'head' AND '{rule_id}' NOT IN ('VID003', 'VID012') THEN 1 ELSE 0 END AS line, '{side}' AS side, t AS snippet
      FROM (SELECT *, 'tests/test_m' || c_custkey || '.py' AS p, 'tests/test_m' || c_custkey || '.py::test_case' AS t FROM customer) WHERE c_custkey % 12 IN ({shapes})"""


def _either(values) -> str:
    return "[" + ", ".join(str(v).lower() for v in values) + "]"


# Lines of both sides of a test's assertions on f(i), numbered by running counts; those on the same i are aligned.
_EXPECTED = """
a AS (SELECT c_custkey AS k, i, (c_custkey * 7 + i) % 10 AS v, (c_custkey + i) % 5 <> 4 AS old, (c_custkey + i) % 7 <> 1 AS new, (c_custkey + i) % 6 = 2 AS more, (c_custkey + i) % 4 = 0 AS edited FROM customer, range(6) r(i)),
n AS (SELECT *, 4 + sum(CAST(old AS INTEGER)) OVER w AS bl, 4 + sum(CAST(new AS INTEGER) + CAST(more AS INTEGER)) OVER w AS hl FROM a WINDOW w AS (PARTITION BY k ORDER BY i))"""

ORACLES = {
    "vid006_literal_edited": f"""
      WITH {_EXPECTED},
      f AS (SELECT k AS cs_id, 'tests/test_e' || k || '.py' AS path, 'Expected literal edited' AS title, '`tests/test_e' || k || '.py::test_values` expected `' || v || '`, now `' || (v + 1) || '`, in a change that touches code too.' AS detail,
        bl, 'f(' || i || ') | ' || v AS bt, hl, 'f(' || i || ') | ' || (v + 1) AS ht FROM n WHERE old AND new AND edited AND k % 3 <> 0)
      SELECT {_TWO}, 'VID006' AS rule_id FROM f""",
    "vid007_unit_mocked": f"""
      WITH m AS (SELECT c_custkey AS k, ['m.run', 'pkg.run', 'os.path.join', 'pkg.mod.old', 'm.run', 'pkg.mod.run'][c_custkey % 6 + 1] AS target, c_custkey % 4 <> 3 AS touched FROM customer),
      f AS (SELECT k AS cs_id, 'tests/test_k' || k || '.py' AS path, 'Unit under test mocked' AS title, '`tests/test_k' || k || '.py::test_run` now replaces `' || target || '`, which is `pkg.mod.run` of src/pkg/mod.py, changed here.' AS detail, 7 AS bl, target AS bt, 7 AS hl, target AS ht
        FROM m WHERE touched AND k % 6 NOT IN (2, 3))
      SELECT {_ONE}, 'VID007' AS rule_id FROM f""",
    "vid008_exception_swallowed": f"""
      WITH h AS (SELECT c_custkey AS k, {_either(s for _, s in HANDLERS)}[c_custkey % 4 + 1] AND {_either(s for _, s in ENDINGS)}[c_custkey // 4 % 5 + 1] AS goes_on, unnest(range(1, c_custkey % 3 + 2)) AS i FROM customer),
      f AS (SELECT k AS cs_id, 'tests/test_h' || k || '.py' AS path, 'Exception swallowed around an assertion' AS title, '`tests/test_h' || k || '.py::test_try` goes on when the assertion on `f(' || i || ') | 1` fails.' AS detail, 6 + i AS bl, 'f(' || i || ') | 1' AS bt, 6 + i AS hl, 'f(' || i || ') | 1' AS ht
        FROM h WHERE goes_on AND k % 11 <> 0)
      SELECT {_ONE}, 'VID008' AS rule_id FROM f""",
    "vid001_test_removed": _lost("VID001", "high", 25, "Test removed", "no longer exists.", 8, "base", "0"),
    "vid002_assertion_removed": _lost("VID002", "high", 20, "Assertion removed", "lost 1 assertion(s).", 8, "base", "1, 2"),
    "vid003_test_skipped": _lost("VID003", "high", 15, "Test skipped", "gained a skip marker.", 8, "head", "3, 10"),
    "vid004_tolerance_loosened": _lost("VID004", "medium", 15, "Tolerance loosened", "accepts more than before.", 8, "head", "4, 5"),
    "vid005_assertion_weakened": "SELECT * REPLACE (CASE WHEN cs_id % 12 = 5 THEN replace(detail, 'strength 70.', 'strength 20.') ELSE detail END AS detail) FROM (" + _lost("VID005", "medium", 15, "Assertion weakened", "lost strength 70.", 8, "head", "5, 6") + ")",
    "vid011_untested_code": """
      SELECT c_custkey AS cs_id, 'VID011' AS rule_id, 'low' AS severity, 5 AS penalty, 'Code added without new assertions' AS title, '1 line(s) of code were added with no net new assertion.' AS detail, 'src/m' || c_custkey || '.py' AS path, 7 AS line, 'head' AS side, 'x = ' || c_custkey AS snippet
      FROM customer WHERE c_custkey % 12 <> 8""",
    "vid012_retry_added": _lost("VID012", "medium", 10, "Retry added", "is now retried.", 8, "head", "7"),
    "gate_over_orders": f"WITH {FINDINGS} SELECT band, worst_severity, count(*) AS n, min(value) AS least, max(value) AS most FROM band GROUP BY band, worst_severity",
    "vid009_coverage_lowered": f"WITH {_CONFIG_NUMERIC} SELECT {_TWO} FROM ({_lowered('c')})",
    "vid009_timeout_raised": f"WITH {_CONFIG_NUMERIC} SELECT {_TWO} FROM ({_raised('c')})",
    "vid009_flags": f"WITH {FLAG_LINES} SELECT {_ONE} FROM ({_FLAGS})",
    "vid009_strict_flip": f"WITH {FLAG_LINES} SELECT {_TWO} FROM ({_STRICT})",
    "vid009_or_true": f"WITH {FLAG_LINES} SELECT {_ONE} FROM ({_OR_TRUE})",
    "vid009_retry_window": f"""
      WITH l AS (SELECT o_orderkey AS cs_id, i + 1 AS line_no, CASE WHEN i = 19 THEN '      uses: nick-fields/retry@v3' WHEN i = o_custkey % 45 THEN '          command: npm run test' ELSE '  step ' || i END AS text FROM orders, range(45) r(i)),
      f AS (SELECT cs_id, '.github/workflows/ci.yml' AS path, 'Retry wrapper added around a test step' AS title, 'A `nick-fields/retry`-style wrapper was added around what looks like a test run in .github/workflows/ci.yml, hiding intermittent failures.' AS detail,
        line_no AS bl, trim(text) AS bt, line_no AS hl, trim(text) AS ht FROM l a
        WHERE contains(text, 'nick-fields/retry') AND EXISTS (SELECT 1 FROM l b WHERE b.cs_id = a.cs_id AND b.line_no BETWEEN a.line_no - 4 AND a.line_no + 15 AND regexp_matches(b.text, 'npm run test')))
      SELECT {_ONE} FROM f""",
    "vid010_ignore_flag": f"WITH {FLAG_LINES} SELECT {_ONE} FROM ({_IGNORED})",
    "vid010_gitignore": f"WITH {FLAG_LINES} SELECT {_ONE} FROM ({_GITIGNORE})",
    "vid010_list_changes": f"""
      WITH {_LIST_CONTENT},
      c AS (
        SELECT lh.k, 'Test directory added to `norecursedirs`' AS title, unnest(list_filter(lh.items, lambda z: NOT list_contains(lb.items, z) AND (contains(z, 'test') OR contains(z, 'spec')))) AS item, ' was added to `norecursedirs` in pytest.ini, so pytest skips it.' AS rest, 'head' AS side, false AS y FROM lb JOIN lh USING (k)
        UNION ALL SELECT lh.k, 'Test file added to `collect_ignore`', unnest(list_filter(lh.ci, lambda z: NOT list_contains(lb.ci, z))), ' was added to `collect_ignore` in pytest.ini.', 'head', true FROM lb JOIN lh USING (k)
        UNION ALL SELECT lh.k, '`testpaths` narrowed', unnest(list_filter(CASE WHEN lb.broken THEN [] ELSE lb.items END, lambda z: lh.broken OR NOT list_contains(lh.items, z))), ' was dropped from `testpaths` in pytest.ini; pytest no longer discovers it.', 'base', false FROM lb JOIN lh USING (k)
      ),
      f AS (SELECT k AS cs_id, 'pytest.ini' AS path, title, '`' || item || '`' || rest AS detail, CASE WHEN y THEN 5 ELSE 2 END AS bl, item AS bt, CASE WHEN y THEN 5 ELSE 2 END AS hl, item AS ht, side FROM c)
      SELECT {_FLAT.format('side', 'side')} FROM f""",
    "vid010_list_items": f"""
      WITH {_LIST_CONTENT}
      SELECT k AS cs_id, key, array_to_string(list_sort(items), '|') AS items, CAST(len(items) AS BIGINT) AS n FROM (
        SELECT k, 'norecursedirs' AS key, items FROM lh UNION ALL SELECT k, 'testpaths', CASE WHEN broken THEN NULL ELSE items END FROM lh
        UNION ALL SELECT k, 'collect_ignore', ci FROM lh UNION ALL SELECT k, 'omit', NULL FROM lh)""",
    "tokens": f"""
      WITH {_LIST_CONTENT}, l AS (
        SELECT k, 1 AS line_no, ['pytest'] AS x FROM lh UNION ALL SELECT k, 2, list_append(items, 'norecursedirs') FROM lh UNION ALL SELECT k, 3, ['testpaths'] FROM lh
        UNION ALL SELECT k, 4, items FROM lh UNION ALL SELECT k, 5, list_append(ci, 'collect_ignore') FROM lh)
      SELECT k AS cs_id, line_no, array_to_string(list_sort(x), '|') AS tokens FROM l""",
    "findings_sorted": f"WITH {FINDINGS} SELECT cs_id, rule_id, 'high' AS severity, 3 AS severity_rank, 20 AS penalty, title, location, CAST(row_number() OVER (PARTITION BY cs_id ORDER BY rule_id, location, file_ord, title) AS INTEGER) AS place FROM (SELECT *, path || ':' || bl AS location FROM judged)",
    "justified_findings": f"WITH {FINDINGS} SELECT cs_id, rule_id, title, justification, 0 AS effective_penalty FROM judged WHERE justification IS NOT NULL",
    "trust_score": f"WITH {FINDINGS} SELECT cs_id, value, 70 AS threshold, n AS n_unjustified, worst_severity, value >= 70 AS passed, band, {_SUMMARY} AS summary FROM band",
    "score_bands": f"""
      WITH v AS (SELECT *, value % 3 AS n, CASE WHEN value >= 90 THEN 'trusted' WHEN value >= threshold THEN 'acceptable' WHEN value >= 40 THEN 'suspect' ELSE 'untrusted' END AS band FROM (SELECT o_orderkey AS cs_id, CAST(o_orderkey % 101 AS INTEGER) AS value, [70, 95, 30][o_custkey % 3 + 1] AS threshold FROM orders))
      SELECT cs_id, value, threshold, band, value >= threshold AS passed, {_SUMMARY} AS summary FROM v""",
    "rule_overrides": f"WITH {FLAG_LINES}, {_numeric('f', 'flag_lines')}, r AS ({_lowered('f')} UNION ALL {_raised('f')} UNION ALL {_FLAGS} UNION ALL {_STRICT} UNION ALL {_OR_TRUE}) SELECT 'VID009' AS rule_id, 'low' AS severity, 0 AS penalty, count(*) AS n FROM r",
    "glob_match_test_paths": rf"""
      WITH {_TEXT} SELECT doc_id AS cs_id, path, NOT starts_with(path, 'src1/') AND regexp_matches(path, '{_TESTS}') AS is_test, regexp_matches(path, '^src[^/]/[^/]*/test_[1-4][^/]*\.py$') AS set_match, true AS related, path AS normalized FROM d""",
    "detect_languages": f"""
      WITH {_TEXT} SELECT doc_id AS cs_id, path, CASE WHEN suffix(path, '.pyi') OR suffix(path, '.py') THEN 'python' WHEN suffix(path, '.tsx') THEN 'tsx' WHEN suffix(path, '.ts') THEN 'typescript' WHEN suffix(path, '.js') THEN 'javascript' END AS language FROM d""",
    "test_file_split": f"WITH {_TEXT} SELECT doc_id AS cs_id, path, NOT starts_with(path, 'src2/') AND regexp_matches(path, '{_TESTS}') AS is_test FROM d",
    "file_lines": f"WITH {_TEXT}, k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, count(*) OVER (PARTITION BY doc_id) AS c FROM x WHERE (doc_id + n) % 7 <> 0) SELECT doc_id AS cs_id, CAST(i AS INTEGER) AS line_no, line AS text FROM k WHERE NOT (i = c AND line = '')",
    "nth_line": f"WITH {_TEXT} SELECT w.doc_id, CAST(w.doc_id % 6 - 1 AS INTEGER) AS n, coalesce(x.line, '') AS line FROM w LEFT JOIN x ON x.doc_id = w.doc_id AND x.n = w.doc_id % 6 - 1",
    "changed_lines": f"WITH {CONFIG_LINES} SELECT cs_id, path, side, line_ord, line_no, text FROM config_lines",
    "changed_text": f"WITH {CONFIG_LINES} SELECT cs_id, string_agg(text, chr(10) ORDER BY line_ord) FILTER (WHERE side = 'head') AS added_text, string_agg(text, chr(10) ORDER BY line_ord) FILTER (WHERE side = 'base') AS removed_text FROM config_lines GROUP BY cs_id",
    "change_lookup": f"""
      WITH {CONFIG_LINES}, f AS (SELECT DISTINCT cs_id % 500 AS cs_id, line_no AS file_ord, path FROM config_lines WHERE line_ord = 0 AND side = 'base'),
      g AS (SELECT *, CASE WHEN file_ord % 3 = 0 THEN 'added' ELSE 'modified' END AS kind, min(file_ord) OVER (PARTITION BY cs_id) AS first FROM f WHERE path = 'pyproject.toml')
      SELECT cs_id, file_ord, path, kind FROM g WHERE file_ord = first AND kind = 'added'""",
    "hunks_from_pair": f"""
      WITH {_TEXT}, k AS (SELECT doc_id, line, n, total, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, count(*) OVER (PARTITION BY doc_id) AS c FROM x WHERE (doc_id + n) % 7 <> 0),
      kept AS (SELECT doc_id, count(*) AS kept FROM k WHERE NOT (i = c AND line = '') GROUP BY doc_id)
      SELECT w.doc_id AS cs_id, len(lines) - coalesce(kept, 0) AS n_removed, CAST(0 AS BIGINT) AS n_added FROM w LEFT JOIN kept USING (doc_id)""",
    "parse_unified_diff": """
      SELECT o_orderkey AS cs_id, CASE WHEN ok THEN 'src/m' || o_orderkey || '.py' END AS path, CASE WHEN ok THEN 'modified' END AS kind, CASE WHEN ok THEN CAST(o_orderkey % 50 + 1 AS INTEGER) END AS base_start, CASE WHEN ok THEN 3 END AS head_lines,
        CASE WHEN ok THEN CAST(o_orderkey % 50 + 2 AS INTEGER) END AS line_no, CASE WHEN ok THEN 'new ' || o_custkey END AS added, CASE WHEN ok THEN 'old ' || o_custkey END AS removed, NOT ok AS failed
      FROM (SELECT *, o_orderkey % 7 <> 0 AS ok FROM orders)""",
    "blob_attach": """
      SELECT o_orderkey AS cs_id, 'f' || o_orderkey % 50 AS path, kind, CASE WHEN kind <> 'added' AND NOT b AND (kind = 'renamed' OR o_orderkey % 50 <> 7) THEN CASE WHEN kind = 'renamed' THEN 'g' ELSE 'f' END || o_orderkey % 50 || '@r' || o_orderkey % 3 END AS base_content,
        CASE WHEN kind <> 'deleted' AND NOT b AND o_orderkey % 50 <> 7 THEN 'f' || o_orderkey % 50 || '@r' || (o_orderkey % 3 + 1) END AS head_content
      FROM (SELECT *, ['added', 'modified', 'deleted', 'renamed'][o_orderkey % 4 + 1] AS kind, o_orderkey % 10 = 9 AS b FROM orders)""",
    "commit_messages": "SELECT o_orderkey AS cs_id, 0 AS ord, 'first ' || o_orderkey AS message FROM orders UNION ALL SELECT o_orderkey, 1, 'second ' || o_orderpriority FROM orders",
    "pair_tests": f"WITH {_SURFACE} SELECT *, head_strength - base_strength AS strength_delta FROM p",
    "removed_tests": f"WITH {_SURFACE} SELECT cs_id, test_id FROM p WHERE removed",
    "added_tests": f"WITH {_SURFACE} SELECT cs_id, test_id FROM p WHERE added",
    "surface_strength": f"WITH {_SURFACE} SELECT cs_id, side, count(*) AS n_tests, count(*) FILTER (WHERE runs) AS n_running, CAST(sum(n) AS BIGINT) AS n_assertions, CAST(coalesce(sum(strength) FILTER (WHERE runs), 0) AS BIGINT) AS strength FROM t GROUP BY cs_id, side",
    "assertion_signatures": f"WITH {_SURFACE} SELECT kind || ':assert:p' || l_partkey || '|s' || l_suppkey AS signature, side, count(*) AS n, CAST(max({_RANK}) AS BIGINT) AS strength FROM s GROUP BY ALL",
    "extract_surface": """
      WITH c AS (SELECT c_custkey AS k FROM customer)
      SELECT k AS cs_id, 'tests/test_c' || k || '.py::test_balance' AS test_id, true AS will_run, CAST(2 AS BIGINT) AS n_assertions, CAST(120 AS BIGINT) AS strength, 4 AS line_start, 7 AS line_end, 'equality' AS first_kind, 'value|' || k AS first_operands, 'load' AS symbols FROM c
      UNION ALL SELECT k, 'tests/test_c' || k || '.py::test_segment', false, 1, 70, 10, 12, 'membership', 'check(' || k % 7 || ')|[' || k % 3 || ']', 'check' FROM c""",
    "surface_states": f"""
      WITH {_TEXT}, k AS (SELECT doc_id, doc_id % 6 IN (0, 4) AND regexp_matches(path, '{_TESTS}') AS python, CASE WHEN doc_id % 12 = 0 THEN 'added' WHEN doc_id % 18 = 6 THEN 'deleted' ELSE 'modified' END AS kind FROM d)
      SELECT doc_id AS cs_id, side, status, CASE status WHEN 'unparsed' THEN false WHEN 'parsed' THEN true WHEN 'absent' THEN true END AS parse_ok FROM (
        SELECT doc_id, 'base' AS side, CASE WHEN NOT python THEN 'not_applicable' WHEN kind = 'added' THEN 'absent' WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'parsed' END AS status FROM k
        UNION ALL SELECT doc_id, 'head', CASE WHEN NOT python THEN 'not_applicable' WHEN kind = 'deleted' THEN 'absent' ELSE 'unparsed' END FROM k)""",
    "captures": "SELECT c_custkey AS cs_id, 'load(' || c_custkey || ')' AS text, 5 AS line FROM customer UNION ALL SELECT c_custkey, 'check(' || c_custkey % 7 || ')', 12 FROM customer",
} | branch_queries.ORACLES
