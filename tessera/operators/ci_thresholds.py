"""VID009: a gate was lowered in a changed CI or tool configuration.

All that a check compares is one file's: its hunks, for retry actions its head content too. So a check is an array of
findings over a file's row, and no line leaves its file. Each check is worked out only for files
whose changed lines hold, in lower case, a part that each of its findings must hold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import GateConfig
from tessera.functions.dealing import growing
from tessera.functions.lines import bound, lines_of, matching_lines, stripped
from tessera.functions.paths import matches_any
from tessera.operators.rules import KEYS, changed, each_found, evidence, found, found_if, number_text, rule, text

# The files in scope, the patterns of settings and flags, and the titles.
WORKFLOWS = (".github/workflows/*.yml", ".github/workflows/*.yaml")
SCOPE = (
    *WORKFLOWS,
    "pyproject.toml",
    "setup.cfg",
    "tox.ini",
    ".coveragerc",
    "pytest.ini",
    "mypy.ini",
    "jest.config.*",
    "vitest.config.*",
    "package.json",
    "Makefile",
    ".pre-commit-config.yaml",
)
NUMBER = r"(\d+(?:\.\d+)?)"


class Setting(NamedTuple):
    """A numeric setting: the place of its check, its label, its pattern, the group of the value, and a part, in lower case, of each line that has it. `key` is what group 1 must be, where one pattern serves several settings."""

    order: int
    label: str
    pattern: str
    part: str
    group: int = 1
    key: str | None = None


_KEYED = ("branches", "functions", "lines", "statements")
LOWERED = (
    Setting(0, "fail_under", rf"(?i)(?<!-)\bfail[-_]under\s*[:=]\s*{NUMBER}", "under"),
    Setting(1, "--cov-fail-under", rf"--cov-fail-under[= ]{NUMBER}", "--cov-fail-under"),
    *(Setting(2, "coverageThreshold", rf"({'|'.join(_KEYED)})\s*:\s*{NUMBER}", key, 2, key) for key in _KEYED),
)
RAISED = (
    Setting(30, "timeout-minutes", rf"\btimeout-minutes\s*:\s*{NUMBER}", "timeout-minutes"),
    Setting(31, "--timeout", rf"--timeout[= ]{NUMBER}", "--timeout"),
    Setting(32, "testTimeout", rf"\btestTimeout\s*:\s*{NUMBER}", "testtimeout"),
)
FACTOR = 2.0
CONTINUE_ON_ERROR = r"(?i)\bcontinue-on-error\s*:\s*true\b"
BYPASSES = (("--no-verify", r"--no-verify\b"), ("--no-validate", r"--no-validate\b"), ("HUSKY=0", r"\bHUSKY=0\b"))
EXIT_ZERO = r"--exit-zero\b"
STRICT = r"(?i)^\s*strict\s*=\s*{}\s*$"
OR_TRUE = r"^(.*\S)\s*\|\|\s*true\s*$"
RETRY = "nick-fields/retry"
RUNNER = r"(?i)\b(pytest|jest|vitest|mocha|rspec|phpunit|go\s+test|dotnet\s+test|npm\s+(?:run\s+)?test|yarn\s+test|pnpm\s+test)\b"
#: Lower-case parts of which every runner's line has one: most lines are told by them alone.
RUNNER_PARTS = ("est", "mocha", "rspec", "phpunit")
BEFORE, AFTER = 4, 15


def scoped(files: DataFrame) -> DataFrame:
    return files.where(matches_any(F.col("path"), SCOPE))


def _holds(text_: Column, *parts: str) -> Column:
    return reduce(and_, (F.contains(text_, F.lit(p)) for p in parts))


def _cited(line: Column) -> Column:
    """An added line as the only evidence."""
    return F.array(evidence(line["line_no"], "head", stripped(line["text"])))


_VALUE = "struct<line_no:int,text:string,value:double,line_ord:int>"
_EDITS = f"array<struct<label:string,check_ord:int,rose:boolean,base:{_VALUE},head:{_VALUE}>>"


def edits(*settings: Setting) -> Column:
    """Settings that were edited exactly once on each side, to a lower threshold or a time that is FACTOR times as long. The first match on a line counts."""

    def edit(setting: Setting) -> Column:
        rose = setting in RAISED

        def values(side: str) -> Column:
            def named(body: Column) -> Column:
                return body.rlike(setting.pattern) if setting.key is None else F.regexp_extract(body, setting.pattern, 1) == setting.key

            value = lambda x: F.regexp_extract(x["text"], setting.pattern, setting.group).try_cast("double")
            return F.transform(matching_lines(F.col(side), named), lambda x: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), value(x).alias("value"), x["line_ord"].alias("line_ord")))

        def worse(x: Column) -> Column:
            was, now = x["base"]["value"], x["head"]["value"]
            return (was > 0) & (now >= FACTOR * was) if rose else now < was

        def once(x: Column) -> Column:
            one = F.zip_with(x["base"], x["head"], lambda b, h: F.struct(F.lit(setting.label).alias("label"), F.lit(setting.order).alias("check_ord"), F.lit(rose).alias("rose"), b.alias("base"), h.alias("head")))
            return F.when((F.size(x["base"]) == 1) & (F.size(x["head"]) == 1), F.filter(one, worse))

        there = _holds(F.col("gone"), setting.part) & _holds(F.col("came"), setting.part)
        return F.coalesce(F.when(there, bound(F.struct(values("removed").alias("base"), values("added").alias("head")), once)), F.expr(f"cast(array() as {_EDITS})"))

    return F.concat(*[edit(s) for s in settings])


def moved(edited: Column) -> Column:
    """Findings of edited settings. The texts of numbers are large expressions: they stand here once for all settings."""

    def told(x: Column) -> Column:
        base, head, rose = x["base"], x["head"], x["rose"]
        both = F.array(evidence(base["line_no"], "base", stripped(base["text"])), evidence(head["line_no"], "head", stripped(head["text"])))
        numbers = F.transform(F.array(base["value"], head["value"]), number_text)
        change = bound(numbers, lambda n: text("`", x["label"], F.when(rose, "` rose from ").otherwise("` dropped from "), F.get(n, F.lit(0)), " to ", F.get(n, F.lit(1)), " in ", F.col("path")))
        title = F.when(rose, "Test timeout raised substantially").otherwise("Coverage threshold lowered")
        return found(title, text(change, F.when(rose, f", more than {FACTOR:g}x.").otherwise(".")), both, x["check_ord"], head["line_ord"])

    # Named twice, the edits stay a column of their own, in compiled code.
    return found_if(F.size(edited) > 0, F.transform(edited, told))


def flagged() -> list[Column]:
    """A finding for each flag that an added line has."""
    path = F.col("path")

    def flag(order: int, part: str, pattern: str, title: str, *detail: Column | str, also: Column | None = None) -> Column:
        own = F.transform(matching_lines(F.col("added"), lambda body: body.rlike(pattern)), lambda x: found(F.lit(title), text(*detail), _cited(x), order, x["line_ord"]))
        there = _holds(F.col("came"), part)
        return found_if(there if also is None else there & also, own)

    out = [flag(10, "continue-on-error", CONTINUE_ON_ERROR, "`continue-on-error: true` added", "A step or job in ", path, " was allowed to fail without failing the workflow.", also=matches_any(path, WORKFLOWS))]
    out += [flag(11, label.lower(), p, f"`{label}` added to a command", f"`{label}` skips a verification hook in ", path, ".") for label, p in BYPASSES]
    return [*out, flag(21, "--exit-zero", EXIT_ZERO, "`--exit-zero` added to a linter invocation", "A linter in ", path, " can no longer fail the build.")]


def strict_flip() -> Column:
    """A removed `strict = true` and exactly one added `strict = false`; the first removed line is cited."""

    def lines(side: str, value: str) -> Column:
        return matching_lines(F.col(side), lambda body: body.rlike(STRICT.format(value)))

    def flipped(x: Column) -> Column:
        was, now = F.get(x["base"], F.lit(0)), F.get(x["head"], F.lit(0))
        both = F.array(evidence(was["line_no"], "base", F.lit("strict = true")), evidence(now["line_no"], "head", stripped(now["text"])))
        one = found(F.lit("mypy `strict` downgraded"), text("`strict = true` became `strict = false` in ", F.col("path"), "."), both, 20, 0)
        return F.when((F.size(x["base"]) >= 1) & (F.size(x["head"]) == 1), F.array(one))

    return found_if(_holds(F.col("gone"), "strict") & _holds(F.col("came"), "strict"), bound(F.struct(lines("removed", "true").alias("base"), lines("added", "false").alias("head")), flipped))


def forgiven() -> Column:
    """Added `command || true` where the command was a removed line of the same file."""

    def was_removed(body: Column) -> Column:
        def of_command(clean: Column) -> Column:
            return clean.rlike(OR_TRUE) & bound(stripped(F.regexp_extract(clean, OR_TRUE, 1)), lambda command: F.exists("removed", lambda x: stripped(x["text"]) == command))

        return _holds(body, "||") & bound(stripped(body), of_command)

    detail = text("A previously-failing command in ", F.col("path"), " can no longer fail the build.")
    own = F.transform(matching_lines(F.col("added"), was_removed), lambda x: found(F.lit("`|| true` appended to a check command"), detail, _cited(x), 22, x["line_ord"]))
    return found_if(_holds(F.col("came"), "||"), own)


def retried(actions: Column, head_content: Column) -> Column:
    """Added retry actions, as (line_ord, line_no, text), near a test runner in the head content, of which only the places of runners are looked at."""

    def runs(line: Column) -> Column:
        return bound(F.lower(line), lambda low: reduce(or_, (F.contains(low, F.lit(p)) for p in RUNNER_PARTS))) & line.rlike(RUNNER)

    def near(runners: Column) -> Column:
        reached = F.filter(actions, lambda x: F.exists(runners, lambda n: n.between(x["line_no"] - BEFORE, x["line_no"] + AFTER)))
        detail = text("A `nick-fields/retry`-style wrapper was added around what looks like a test run in ", F.col("path"), ", hiding intermittent failures.")
        return F.transform(reached, lambda x: found(F.lit("Retry wrapper added around a test step"), detail, _cited(x), 40, x["line_ord"]))

    marked = F.transform(lines_of(head_content), lambda x, i: F.when(runs(x), i + 1))
    return found_if(_holds(head_content, RETRY), bound(F.array_compact(marked), near))


def retry_added() -> Column:
    return found_if(_holds(F.col("came"), RETRY), retried(matching_lines(F.col("added"), lambda body: _holds(body, RETRY)), F.col("head_content")))


def _scoped(files: DataFrame, check: Column) -> DataFrame:
    """What a check finds in files in scope."""
    return each_found(changed(scoped(files)), lambda rows: (rows, check))


def coverage_lowered(files: DataFrame) -> DataFrame:
    return each_found(changed(scoped(files)).withColumn("edited", edits(*LOWERED)), lambda rows: (rows, moved(F.col("edited"))))


def timeout_raised(files: DataFrame) -> DataFrame:
    return each_found(changed(scoped(files)).withColumn("edited", edits(*RAISED)), lambda rows: (rows, moved(F.col("edited"))))


def flags(files: DataFrame) -> DataFrame:
    return _scoped(files, F.concat(*flagged()))


def strict_flipped(files: DataFrame) -> DataFrame:
    return _scoped(files, strict_flip())


def or_true(files: DataFrame) -> DataFrame:
    return _scoped(files, forgiven())


def retries(files: DataFrame) -> DataFrame:
    return _scoped(files, retry_added())


def retry_wrapped(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The same for lines that come by themselves: a file's added retry actions meet its content in a join of files with files."""
    actions = lines.where((F.col("side") == "head") & F.contains("text", F.lit(RETRY))).groupBy(*KEYS).agg(F.collect_list(F.struct("line_ord", "line_no", "text")).alias("actions"))
    rows = scoped(files).where(~F.col("is_binary")).join(growing(actions), [*KEYS])
    return each_found(rows, lambda rows: (rows, retried(F.col("actions"), F.col("head_content"))))


@rule("VID009", "CI threshold lowered", severity="high", penalty=20, of_file=True)
def ci_threshold_lowered(rows: DataFrame, config: GateConfig) -> tuple[DataFrame, Column]:
    rows = rows.withColumn("gates", matches_any(F.col("path"), SCOPE))
    rows = rows.withColumn("edited", F.when(F.col("gates"), edits(*LOWERED, *RAISED)))
    return rows, found_if(F.col("gates"), F.concat(moved(F.col("edited")), *flagged(), strict_flip(), forgiven(), retry_added()))
