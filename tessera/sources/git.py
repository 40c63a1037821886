"""Change sets from git ranges.

`spark.read.format("git_ranges")` is a data source with one partition for each range, so many ranges
load side by side, each in a task that can be run again; `load_range` runs git for one range on the
driver, `read_ranges` takes the ranges from a DataFrame. The repositories must be reachable where the
tasks run. All contents of a range come from one process of git.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.lines import stripped
from tessera.schemas import CHANGESETS, FILE_CHANGES, HUNKS
from tessera.sources.unified_diff import DiffError, parse

#: Nothing of a user's configuration may change the diff's bytes.
DIFF = ("diff", "--no-color", "--no-ext-diff", "--unified=3", "--find-renames")
LOG = ("log", "--format=%B%x00")


class GitError(RuntimeError):
    """git failed or could not be started."""


def git(repository: str | Path, *arguments: str) -> str:
    """The output of a git command: UTF-8 with replacements, CR LF as LF."""
    try:
        done = subprocess.run(["git", "--no-pager", *arguments], cwd=repository, capture_output=True, check=False)
    except OSError as e:
        raise GitError(f"git {' '.join(arguments)} can't be run: {e}") from e
    if done.returncode:
        raise GitError(f"git {' '.join(arguments)} failed: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace").replace("\r\n", "\n")


class Blobs:
    """Files at refs, through one process that answers a request at a time; None where git has no such file, as the hunks tell the change."""

    def __init__(self, repository: str | Path):
        try:
            self.process = subprocess.Popen(["git", "--no-pager", "cat-file", "--batch"], cwd=repository, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        except OSError as e:
            raise GitError(f"git cat-file can't be run: {e}") from e

    def __enter__(self) -> Blobs:
        return self

    def __exit__(self, *_) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()

    def read(self, ref: str, path: str) -> str | None:
        if "\n" in path:  # a request is a line
            return None
        try:
            self.process.stdin.write(f"{ref}:{path}\n".encode())
            self.process.stdin.flush()
            head = self.process.stdout.readline()
        except BrokenPipeError as e:
            raise GitError("git cat-file ended") from e
        if not head:
            raise GitError("git cat-file ended")
        kind, _, size = head.decode("utf-8", "replace").rstrip("\n").rpartition(" ")
        if not size.isdigit() or head.endswith(b" missing\n"):
            return None
        body = self.process.stdout.read(int(size) + 1)[:-1]
        return body.decode("utf-8", "replace").replace("\r\n", "\n") if kind.endswith(" blob") else None


def messages(raw: str) -> list[str]:
    return [m for m in (part.strip() for part in raw.split("\0")) if m]


def split_messages(raw: Column) -> Column:
    """The same as an expression."""
    return F.filter(F.transform(F.split(raw, "\\x00"), stripped), lambda m: m != "")


def load(repository: str | Path, base: str, head: str, *, contents: bool = True) -> tuple[list[dict], list[str]]:
    """(file changes, with contents unless these aren't wanted, and commit messages) of a range."""
    files = parse(git(repository, *DIFF, base, head))
    with Blobs(repository) if contents and files else nullcontext() as blobs:
        for f in files:
            wanted = blobs is not None and not f["is_binary"]
            f["base_content"] = blobs.read(base, f["base_path"] or f["path"]) if wanted and f["kind"] != "added" else None
            f["head_content"] = blobs.read(head, f["path"]) if wanted and f["kind"] != "deleted" else None
    return files, messages(git(repository, *LOG, f"{base}..{head}"))


_ORDER = ("path", "kind", "base_path", "base_content", "head_content", "is_binary", "hunks")


def load_range(spark: SparkSession, repository: str | Path, base: str, head: str, *, cs_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(changesets, file_changes) of one range. Raises GitError or DiffError."""
    files, said = load(repository, base, head)
    rows = [(cs_id, i, *(f[n] for n in _ORDER)) for i, f in enumerate(files)]
    return spark.createDataFrame([(cs_id, base, head, said, None)], CHANGESETS), spark.createDataFrame(rows, FILE_CHANGES)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """Rows (cs_id, base_ref, head_ref, commit_messages, parse_error, files) for ranges (cs_id, repository, base, head).
    A range that fails has its error and no files; the others aren't stopped by it."""
    out = f"{CHANGESETS}, files array<struct<path:string,kind:string,base_path:string,base_content:string,head_content:string,is_binary:boolean,hunks:{HUNKS}>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    files, said = load(r.repository, r.base, r.head)
                    rows.append((r.cs_id, r.base, r.head, said, None, [{n: f[n] for n in _ORDER} for f in files]))
                except (GitError, DiffError) as e:
                    rows.append((r.cs_id, r.base, r.head, None, str(e), None))
            yield pd.DataFrame(rows, columns=["cs_id", "base_ref", "head_ref", "commit_messages", "parse_error", "files"])

    return ranges.select("cs_id", "repository", "base", "head").mapInPandas(run, out)


def files_of(loaded: DataFrame) -> DataFrame:
    """file_changes from read_ranges()."""
    return loaded.select("cs_id", F.posexplode("files").alias("file_ord", "f")).select("cs_id", "file_ord", "f.*")


_RANGE = ("cs_id", "base_ref", "head_ref", "commit_messages", "parse_error")


@dataclass
class Range(InputPartition):
    """One range: a partition of the source."""

    cs_id: int
    repository: str
    base: str
    head: str


class GitRanges(DataSource):
    """Options: `ranges`, a JSON list of objects with cs_id, repository, base and head, or these four for one range (cs_id is 0 by
    default); `contents`, false for changes without contents; `mode`, PERMISSIVE (a range that fails is a row with its
    error) or FAILFAST. A range without changed files is one row without a path."""

    @classmethod
    def name(cls) -> str:
        return "git_ranges"

    def schema(self) -> str:
        return f"{CHANGESETS}, file_ord int, path string, kind string, base_path string, base_content string, head_content string, is_binary boolean, hunks {HUNKS}"

    def reader(self, schema) -> DataSourceReader:
        own = dict(self.options)
        given = json.loads(own["ranges"]) if "ranges" in own else [{"cs_id": int(own.get("cs_id", 0)), **{k: own[k] for k in ("repository", "base", "head") if k in own}}]
        for r in given:
            if set(r) != {"cs_id", "repository", "base", "head"}:
                raise ValueError(f"a range has cs_id, repository, base and head, not {sorted(r)}")
        mode = own.get("mode", "PERMISSIVE").upper()
        if mode not in ("PERMISSIVE", "FAILFAST"):
            raise ValueError(f"no such mode: {mode!r}")
        return _RangeReader([Range(**r) for r in given], own.get("contents", "true").lower() != "false", mode)


class _RangeReader(DataSourceReader):
    def __init__(self, ranges: list[Range], contents: bool, mode: str):
        self.ranges, self.contents, self.mode = ranges, contents, mode

    def partitions(self) -> list[InputPartition]:
        return list(self.ranges)

    def read(self, partition: Range) -> Iterator[tuple]:
        nothing = (None,) * (1 + len(_ORDER))
        try:
            files, said = load(partition.repository, partition.base, partition.head, contents=self.contents)
        except (GitError, DiffError) as e:
            if self.mode == "FAILFAST":
                raise
            yield (partition.cs_id, partition.base, partition.head, None, str(e), *nothing)
            return
        whole = (partition.cs_id, partition.base, partition.head, said, None)
        if not files:
            yield (*whole, *nothing)
        for i, f in enumerate(files):
            yield (*whole, i, *(f[n] for n in _ORDER))


def register(spark: SparkSession) -> None:
    """Makes `spark.read.format("git_ranges")` known to the session."""
    spark.dataSource.register(GitRanges)


def split_ranges(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changesets, file_changes) from rows of the source; both read the same rows, so these are better kept or written first."""
    return loaded.select(*_RANGE).dropDuplicates(["cs_id"]), loaded.where(F.col("path").isNotNull()).select("cs_id", "file_ord", *_ORDER)


def attach_blobs(files: DataFrame, changesets: DataFrame, blobs: DataFrame) -> DataFrame:
    """Parsed changes with contents from blobs (ref, path, content): the base side unless added, at its old path;
    the head side unless deleted; none for binary files; null where there is no such blob."""
    refs = changesets.select("cs_id", "base_ref", "head_ref")
    keyed = files.drop("base_content", "head_content").join(refs, "cs_id")
    base = blobs.select(F.col("ref").alias("base_ref"), F.col("path").alias("base_key"), F.col("content").alias("base_content"))
    head = blobs.select(F.col("ref").alias("head_ref"), F.col("path").alias("head_key"), F.col("content").alias("head_content"))
    text = ~F.col("is_binary")
    keyed = keyed.withColumn("base_key", F.when(text & (F.col("kind") != "added"), F.coalesce("base_path", "path"))).withColumn("head_key", F.when(text & (F.col("kind") != "deleted"), F.col("path")))
    # Each content is shuffled once: it meets its keys alone, and both sides come together by (cs_id, file_ord).
    keys = keyed.select("cs_id", "file_ord", "base_ref", "head_ref", "base_key", "head_key")
    old = keys.where(F.col("base_key").isNotNull()).join(base, ["base_ref", "base_key"]).select("cs_id", "file_ord", "base_content")
    new = keys.where(F.col("head_key").isNotNull()).join(head, ["head_ref", "head_key"]).select("cs_id", "file_ord", "head_content")
    out = keyed.join(old, ["cs_id", "file_ord"], "left").join(new, ["cs_id", "file_ord"], "left")
    return out.select("cs_id", "file_ord", "path", "kind", "base_path", "base_content", "head_content", "is_binary", "hunks")
