"""The rule registry and what all rules share.

A rule is a function of a Context to a DataFrame of raw findings; it is registered under an id with a
default severity and penalty. A rule that reads nothing but one file's row is a function of changed files (as
`changed` gives them) and the configuration to the same files, perhaps with columns of its own, and a column: an array of
raw findings. All such rules are met in one pass over the files, without a shuffle.
Modules of rules register themselves when `discover` imports them. A rule that the configuration disables adds
nothing to the plan.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import GateConfig, RuleSetting
from tessera.functions.lines import change_lines, line_texts, side_lines
from tessera.functions.paths import is_test_path
from tessera.schemas import EVIDENCE, SEVERITIES

KEYS = ("cs_id", "file_ord", "path")
#: What a rule of one file finds in it.
RAW = f"array<struct<title:string,detail:string,evidence:array<{EVIDENCE}>,check_ord:int,line_ord:int>>"


@dataclass
class Context:
    """What rules may read: file changes, configuration, and surfaces where they were extracted. With `keep`,
    what several rules read (changed lines, paired tests) is made once and kept, on disk where memory doesn't do; lost parts are made again."""

    files: DataFrame
    config: GateConfig = field(default_factory=GateConfig)
    surfaces: DataFrame | None = None
    keep: bool = False
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What several rules read, planned once and, with `keep`, kept until release()."""
        if name not in self._made:
            made = make()
            self._made[name] = made.persist(StorageLevel.MEMORY_AND_DISK) if self.keep else made
        return self._made[name]

    @property
    def lines(self) -> DataFrame:
        return self.once("lines", lambda: change_lines(self.text_files()))

    def release(self) -> None:
        """Gives kept tables back. What was planned on them still runs, from their sources."""
        for made in self._made.values():
            made.unpersist()

    def text_files(self) -> DataFrame:
        return self.files.where(~F.col("is_binary"))

    def test_files(self) -> DataFrame:
        return self.files.where(~F.col("is_binary") & is_test_path(F.col("path"), self.config))

    def non_test_files(self) -> DataFrame:
        return self.files.where(~F.col("is_binary") & ~is_test_path(F.col("path"), self.config))


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    check: Callable
    severity: str = "medium"
    penalty: int = 10
    of_file: bool = False

    def setting(self, config: GateConfig) -> RuleSetting | None:
        """What holds for the rule; None where it is disabled. Overrides of the configuration win, a penalty of 0 among them."""
        own = config.effective(self.id, self.severity, self.penalty)
        return own if own.enabled else None

    def marked(self, config: GateConfig, title: Column, detail: Column, evidence: Column, check_ord: Column, line_ord: Column) -> list[Column]:
        """A finding's own columns with what the configuration says of its rule."""
        own = self.setting(config)
        return [
            F.lit(self.id).alias("rule_id"), F.lit(own.severity).alias("severity"), title.alias("title"), detail.alias("detail"), F.lit(own.penalty).alias("penalty"), evidence.alias("evidence"),
            check_ord.alias("check_ord"), line_ord.alias("line_ord"),
        ]


RAW_COLUMNS = ("title", "detail", "evidence", "check_ord", "line_ord")
_ORDER = ("cs_id", "rule_id", "severity", "title", "detail", "path", "penalty", "evidence", "justification", "file_ord", "check_ord", "line_ord")


_RULES: dict[str, Rule] = {}


def rule(id: str, name: str, *, severity: str = "medium", penalty: int = 10, of_file: bool = False):
    """Registers a check under an id; a later check of that id takes its place. With `of_file` the check is one on a file's row."""
    if not id:
        raise TypeError("a rule must have an id")
    if severity not in SEVERITIES:
        raise ValueError(f"no such severity: {severity!r}")

    def keep(check: Callable) -> Callable:
        _RULES[id] = Rule(id, name, check, severity, penalty or 10, of_file)
        return check

    return keep


def registered() -> tuple[Rule, ...]:
    return tuple(_RULES[k] for k in sorted(_RULES))


def get_rule(id: str) -> Rule | None:
    return _RULES.get(id)


def discover(package: str = "tessera.operators") -> tuple[Rule, ...]:
    """Imports the package's modules whose names don't begin with an underscore, and returns the registered rules."""
    found = importlib.import_module(package)
    for m in pkgutil.iter_modules(found.__path__):
        if not m.name.startswith("_"):
            importlib.import_module(f"{package}.{m.name}")
    return registered()


def findings(context: Context, rules: tuple[Rule, ...] | None = None) -> DataFrame | None:
    """Findings of all rules; None if all are disabled."""
    config = context.config
    enabled = [r for r in (rules if rules is not None else discover()) if r.setting(config)]
    of_file = [r for r in enabled if r.of_file]
    parts = []
    if of_file:
        parts.append(each_found(changed(context.text_files()), *[(lambda rows, r=r: r.check(rows, config)) for r in of_file], mark=lambda i, f: of_file[i].marked(config, *(f[x] for x in RAW_COLUMNS))))
    for r in enabled:
        if not r.of_file:
            parts.append(r.check(context).select(*KEYS, *r.marked(config, *map(F.col, RAW_COLUMNS))))
    none = F.lit(None).cast("string").alias("justification")
    return reduce(DataFrame.unionByName, [p.withColumn("justification", none).select(*_ORDER) for p in parts]) if parts else None


def changed(files: DataFrame) -> DataFrame:
    """Files as rules of one file read them: keys, contents, the removed and the added lines of all hunks, and the texts of
    these in lower case, `gone` and `came`, by which most files are told from those that a check concerns."""
    rows = files.select(*KEYS, "base_content", "head_content", side_lines(F.col("hunks"), "base").alias("removed"), side_lines(F.col("hunks"), "head").alias("added"))
    return rows.select("*", F.lower(line_texts(F.col("removed"))).alias("gone"), F.lower(line_texts(F.col("added"))).alias("came"))


def each_found(rows: DataFrame, *checks: Callable[[DataFrame], tuple[DataFrame, Column]], mark: Callable[[int, Column], list[Column]] | None = None) -> DataFrame:
    """A row for each finding of checks on changed files. Checks are columns, so that their conditions are compiled code: within a
    generator or a lambda they would not be. The generator alone reads them, so that no filter on their sizes works them out again."""
    found = []
    for check in checks:
        rows, column = check(rows)
        found.append(column)
    names = [f"found_{i}" for i in range(len(found))]
    rows = rows.select(*KEYS, *[x.alias(n) for n, x in zip(names, found, strict=True)])

    def own(i: int) -> Column:
        return F.transform(names[i], lambda f: F.struct(*(mark(i, f) if mark else [f[x].alias(x) for x in RAW_COLUMNS])))

    return rows.select(*KEYS, F.explode(F.concat(*[own(i) for i in range(len(names))])).alias("f")).select(*KEYS, "f.*")


def found(title: Column, detail: Column, evidence: Column, check_ord: Column | int, line_ord: Column | int) -> Column:
    """One raw finding of a rule of one file."""
    own = [x if isinstance(x, Column) else F.lit(x) for x in (title, detail, evidence, check_ord, line_ord)]
    return F.struct(*[x.alias(name) for name, x in zip(RAW_COLUMNS, own, strict=True)])


def found_if(condition: Column, what: Column) -> Column:
    """What is found where a condition holds, worked out there alone; elsewhere, and where it is null, nothing."""
    return F.coalesce(F.when(condition, what), F.expr(f"cast(array() as {RAW})"))


def evidence(line: Column, side: str | Column, snippet: Column, path: Column | None = None) -> Column:
    return F.struct((path if path is not None else F.col("path")).alias("path"), line.cast("int").alias("line"), (F.lit(side) if isinstance(side, str) else side).alias("side"), snippet.alias("snippet"))


_LIMB = 1_000_000_000


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _whole_digits(value: Column) -> Column:
    """All digits of a whole double of 2**53 or more: 54 bits as limbs of nine digits, then doubled as often as the exponent says."""
    power = F.floor(F.log2(value)).cast("int") - 53
    head = (value / F.pow(F.lit(2.0), power)).cast("long")
    limbs = F.concat(F.array(head % _LIMB, _div(head, _LIMB)), F.array_repeat(F.lit(0).cast("long"), 35))

    def times(all_limbs: Column, bits: Column) -> Column:
        def step(state: Column, limb: Column) -> Column:
            product = limb * F.pow(F.lit(2.0), bits).cast("long") + state["carry"]
            return F.struct(F.array_append(state["done"], product % _LIMB).alias("done"), _div(product, _LIMB).alias("carry"))

        start = F.struct(F.expr("cast(array() as array<bigint>)").alias("done"), F.lit(0).cast("long").alias("carry"))
        return F.aggregate(all_limbs, start, step, lambda state: state["done"])

    steps = F.transform(F.sequence(F.lit(0), F.floor(power / 20).cast("int")), lambda i: F.when(i == 0, power % 20).otherwise(20))
    text = F.aggregate(F.aggregate(steps, limbs, times), F.lit(""), lambda done, limb: F.concat(F.lpad(limb.cast("string"), 9, "0"), done))
    return F.regexp_replace(text, "^0+", "")


def number_text(value: Column) -> Column:
    """A number of any size without a needless fraction, small ones with an exponent; never an error."""
    plain = F.regexp_replace(value.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    small = F.regexp_replace(F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0E", "E"), r"E-(\d)$", "E-0$1"), "E", "e")
    whole = F.when(F.abs(value) < 2.0**53, value.cast("long").cast("string")).otherwise(_whole_digits(value))
    return F.when(F.abs(value) == float("inf"), F.lit("inf")).when(value == F.rint(value), whole).when(F.abs(value) < 1e-4, small).otherwise(plain)


def text(*parts: Column | str) -> Column:
    """A text from columns and literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
