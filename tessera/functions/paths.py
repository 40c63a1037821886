"""Globs, test paths and languages as Catalyst expressions.

A glob is turned into a regular expression on the driver, so a plan has one literal pattern for each
list of globs, compiled once for each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import GateConfig

_GLOB_PART = re.compile(r"(?P<dirs>\*\*/)|(?P<deep>\*\*)|(?P<star>\*)|(?P<one>\?)|\[(?P<set>[^\]]*)\]|(?P<plain>.)", re.DOTALL)
# Suffixes of languages.
LANGUAGES = {".py": "python", ".pyi": "python", ".tsx": "tsx", ".ts": "typescript", ".jsx": "javascript", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript"}
#: Languages that have a surface extractor.
EXTRACTORS = ("python",)


def _java_set(body: str) -> str:
    """A class taken as it is written; `[` and `&&` have no meaning there in the pattern's own dialect, so they are escaped for Java's."""
    return "[" + body.replace("[", r"\[").replace("&&", r"&\&") + "]"


def glob_regex(glob: str) -> str:
    """An unanchored Java pattern for one glob. `**/` is any number of directories, `*` and `?` stay within one."""
    out = []
    for m in _GLOB_PART.finditer(glob):
        kind = m.lastgroup
        if kind == "plain":
            out.append(re.sub(r"([^A-Za-z0-9_/])", r"\\\1", m["plain"]))
        elif kind == "set":
            if not m["set"]:
                raise ValueError(f"an empty set in the glob {glob!r}")
            out.append(_java_set(m["set"]))
        else:
            out.append({"dirs": "(?:[^/]+/)*", "deep": ".*", "star": "[^/]*", "one": "[^/]"}[kind])
    return "".join(out)


def globs_regex(globs: Iterable[str]) -> str | None:
    """One anchored pattern for a list of globs; None for an empty list. A final line end in a path may follow."""
    parts = [glob_regex(g) for g in globs]
    return "^(?:" + "|".join(parts) + ")$" if parts else None


def normalized(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    regex = globs_regex(globs)
    return F.lit(False) if regex is None else normalized(path).rlike(regex)


def is_test_path(path: Column, config: GateConfig) -> Column:
    """Ignored globs win."""
    return ~matches_any(path, config.ignore_globs) & matches_any(path, config.test_globs)


def looks_test_related(item: Column, config: GateConfig) -> Column:
    low = F.lower(item)
    return F.contains(low, F.lit("test")) | F.contains(low, F.lit("spec")) | matches_any(item, config.test_globs)


def detect_language(path: Column) -> Column:
    """The language of the longest suffix that a path has; case counts."""
    out = F.lit(None).cast("string")
    for suffix in sorted(LANGUAGES, key=len):
        out = F.when(path.endswith(suffix), LANGUAGES[suffix]).otherwise(out)
    return out
