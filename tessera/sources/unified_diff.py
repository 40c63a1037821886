"""Unified diffs to file changes.

`parse` reads one diff's text; `read_diffs` applies it to a DataFrame of diffs, where one malformed
diff is a row with a parse_error (PERMISSIVE) or stops the job (FAILFAST). A diff is taken whole or
not at all: a change set with a hunk missing would be worse than none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schemas import HUNKS

# The formats of a diff's lines.
HUNK_HEAD = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
BINARY = re.compile(r"Binary files (.+?) and (.+) differ")
GIT_HEAD = "diff --git "
SAME_PATH = re.compile(r"a/(.+) b/\1")
QUOTED_PATHS = re.compile(r'("(?:[^"\\]|\\.)*") ("(?:[^"\\]|\\.)*")')
SPLIT_PATHS = re.compile(r"a/(.+?) b/(.+)")
ESCAPES = {'"': 34, "\\": 92, "n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11}
NULL_FILE = "/dev/null"
#: Line numbers and counts are below this, so that a hunk's last line is still a 32-bit number.
MOST_LINES = 1 << 30

_ESCAPED = re.compile(r"\\([0-7]{1,3})|\\(.)|([^\\]+|\\$)", re.DOTALL)


class DiffError(ValueError):
    """A diff that isn't well-formed."""


def unquoted(token: str) -> str:
    """A path without its C-style quotes; octal escapes are bytes of UTF-8."""
    if len(token) < 2 or not (token[0] == token[-1] == '"'):
        return token
    out = bytearray()
    for octal, char, plain in _ESCAPED.findall(token[1:-1]):
        if octal:
            out.append(int(octal, 8) % 256)
        elif char in ESCAPES:
            out.append(ESCAPES[char])
        else:
            out += (char or plain).encode()
    return out.decode("utf-8", "replace")


def side_path(token: str) -> str | None:
    """The path that a header names, without its one-letter prefix; None for the null file."""
    if token == NULL_FILE:
        return None
    path = unquoted(token)
    return path[2:] if path[1:2] == "/" else path


def _hinted(head: str) -> tuple[str | None, str | None]:
    """Both paths of a section's first line, for sections that name none elsewhere."""
    rest = head[len(GIT_HEAD) :]
    if m := SAME_PATH.fullmatch(rest):
        return m[1], m[1]
    if m := QUOTED_PATHS.fullmatch(rest):
        return side_path(m[1]), side_path(m[2])
    if m := SPLIT_PATHS.fullmatch(rest):
        return m[1], m[2]
    return None, None


class _Lines:
    """Lines with a place in them."""

    def __init__(self, text: str):
        self.all, self.at = text.splitlines(), 0

    def peek(self) -> str | None:
        return self.all[self.at] if self.at < len(self.all) else None

    def next(self) -> str:
        self.at += 1
        return self.all[self.at - 1]

    def skip_while(self, wanted) -> None:
        while (line := self.peek()) is not None and wanted(line):
            self.at += 1


def _hunk(lines: _Lines) -> dict:
    head = lines.next()
    numbers = HUNK_HEAD.match(head).groups()
    if any(n is not None and (len(n) > 18 or int(n) >= MOST_LINES) for n in numbers):
        raise DiffError(f"malformed hunk header: {head!r}")
    starts = {"base": int(numbers[0]), "head": int(numbers[2])}
    sizes = {"base": 1 if numbers[1] is None else int(numbers[1]), "head": 1 if numbers[3] is None else int(numbers[3])}
    seen = {"base": 0, "head": 0}
    changed: dict[str, list[dict]] = {"base": [], "head": []}
    while seen != sizes and any(seen[s] < sizes[s] for s in seen) and (line := lines.peek()) is not None:
        if line.startswith("\\"):
            lines.next()
            continue
        sides = {" ": ("base", "head"), "": ("base", "head"), "-": ("base",), "+": ("head",)}.get(line[:1])
        if sides is None:
            raise DiffError(f"malformed hunk line: {line!r}")
        lines.next()
        if len(sides) == 1:
            changed[sides[0]].append({"line": starts[sides[0]] + seen[sides[0]], "text": line[1:]})
        for s in sides:
            seen[s] += 1
    if seen != sizes:
        raise DiffError(f"the hunk at -{starts['base']},{sizes['base']} +{starts['head']},{sizes['head']} ended before its declared line counts were satisfied")
    lines.skip_while(lambda x: x.startswith("\\"))
    return {"base_start": starts["base"], "base_lines": sizes["base"], "head_start": starts["head"], "head_lines": sizes["head"], "added": changed["head"], "removed": changed["base"]}


def _section(lines: _Lines) -> dict:
    head = lines.next()
    path: dict[str, str | None] = {"base": None, "head": None}
    renamed: dict[str, str] = {}
    flags: set[str] = set()
    hunks: list[dict] = []
    while (line := lines.peek()) is not None and not line.startswith(GIT_HEAD):
        if HUNK_HEAD.match(line):
            hunks.append(_hunk(lines))
            continue
        lines.next()
        if line.startswith(("new file mode", "deleted file mode")):
            flags.add(line.split()[0])
        elif line.startswith(("rename from ", "rename to ")):
            _, half, name = line.split(" ", 2)
            renamed[half] = unquoted(name)
        elif line.startswith("Binary files "):
            if not (m := BINARY.fullmatch(line)):
                raise DiffError(f"malformed binary-file header: {line!r}")
            flags.add("binary")
            path["base"] = side_path(m[1]) or path["base"]
            path["head"] = side_path(m[2]) or path["head"]
        elif line == "GIT binary patch":
            flags.add("binary")
            lines.skip_while(lambda x: not x.startswith(GIT_HEAD))
        elif line.startswith(("--- ", "+++ ")):
            path["base" if line[0] == "-" else "head"] = side_path(line[4:].removesuffix("\t"))
        elif line.startswith("@@"):
            raise DiffError(f"malformed hunk header: {line!r}")
        elif line.startswith((" ", "+", "-", "\\")):
            raise DiffError(f"hunk content line outside of any hunk: {line!r}")
    kind, name, base_path = _named(head, path, renamed, flags)
    return {"path": name, "kind": kind, "base_path": base_path, "is_binary": "binary" in flags, "hunks": hunks}


def _named(head: str, path: dict, renamed: dict, flags: set[str]) -> tuple[str, str, str | None]:
    """(kind, path, base path) of a section."""
    if renamed:
        if len(renamed) < 2:
            raise DiffError(f"rename header missing 'from' or 'to' path: {head!r}")
        return "renamed", renamed["to"], renamed["from"]
    base, new = (path["base"], path["head"]) if path["base"] is not None or path["head"] is not None else _hinted(head)
    if "new" in flags or base is None:
        if new is None:
            raise DiffError(f"added file section has no path: {head!r}")
        return "added", new, None
    if "deleted" in flags or new is None:
        return "deleted", base, None
    return "modified", new, None


def parse(text: str) -> list[dict]:
    """The file changes of one diff, in order. Raises DiffError when it isn't well-formed."""
    lines, out = _Lines(text), []
    while True:
        lines.skip_while(lambda x: not x.strip())
        if (line := lines.peek()) is None:
            return out
        if not line.startswith(GIT_HEAD):
            raise DiffError(f"expected a 'diff --git' header, found: {line!r}")
        out.append(_section(lines))


PARSED = f"cs_id long, file_ord int, path string, kind string, base_path string, is_binary boolean, hunks {HUNKS}, parse_error string"


def read_diffs(diffs: DataFrame, *, mode: str = "PERMISSIVE") -> DataFrame:
    """Rows of PARSED for diffs (cs_id, raw): one for each file change, or one with parse_error and null
    fields for a diff that can't be parsed. An empty or null diff gives no row."""
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"no such mode: {mode!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["cs_id", "file_ord", "path", "kind", "base_path", "is_binary", "hunks", "parse_error"]
        for b in batches:
            rows = []
            for cs, raw in zip(b["cs_id"], b["raw"], strict=True):
                try:
                    rows += [(cs, i, f["path"], f["kind"], f["base_path"], f["is_binary"], f["hunks"], None) for i, f in enumerate(parse(raw or ""))]
                except DiffError as e:
                    if mode == "FAILFAST":
                        raise
                    rows.append((cs, None, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=names)
            out["file_ord"] = out["file_ord"].astype("Int32")
            out["is_binary"] = out["is_binary"].astype("boolean")
            yield out

    return diffs.select("cs_id", "raw").mapInPandas(run, PARSED)


def read_diff_files(spark, path: str, *, mode: str = "PERMISSIVE") -> DataFrame:
    """One diff in each file below path; cs_id is the hash of the file's name."""
    raw = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("cs_id"), F.col("value").alias("raw"))
    return read_diffs(raw, mode=mode)
