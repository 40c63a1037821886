"""Lines of contents and of hunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line: the breaks that a universal split knows, CR LF as one.
BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, however often it is named there: what lambdas read isn't shared otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines_of(content: Column) -> Column:
    """The lines as an array; a final break ends the last line and begins none."""
    return bound(F.split(content, BREAKS, -1), lambda parts: F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def nth_line(content: Column, n: Column) -> Column:
    """The n-th line from 1; empty for a null content, a line below 1 or past the end."""
    return F.when(n < 1, "").otherwise(F.coalesce(F.get(lines_of(content), n - 1), F.lit("")))


def joined(lines: Column) -> Column:
    """The texts of an array of (line, text), by line ends."""
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def side_lines(hunks: Column, side: str) -> Column:
    """The added (head) or removed (base) lines of all hunks, in order."""
    return F.flatten(hunks["added" if side == "head" else "removed"])


def line_texts(lines: Column) -> Column:
    """The texts of an array of (line, text), by line ends; in compiled code, which `joined` over what a lambda makes isn't."""
    return F.array_join(lines["text"], "\n")


def matching_lines(lines: Column, test: Callable[[Column], Column]) -> Column:
    """Lines whose text passes a test, as an array of (line_ord, line_no, text)."""
    numbered = F.transform(lines, lambda x, i: F.when(test(x["text"]), F.struct(i.alias("line_ord"), x["line"].alias("line_no"), x["text"].alias("text"))))
    return F.filter(numbered, lambda x: x.isNotNull())


def change_lines(files: DataFrame) -> DataFrame:
    """A row for each changed line: cs_id, file_ord, path, side, line_ord, line_no, text. Contents are left behind, so shuffles stay small."""
    both = F.concat(
        F.transform(side_lines(F.col("hunks"), "base"), lambda x, i: F.struct(F.lit("base").alias("side"), i.alias("ord"), x["line"].alias("line_no"), x["text"].alias("text"))),
        F.transform(side_lines(F.col("hunks"), "head"), lambda x, i: F.struct(F.lit("head").alias("side"), i.alias("ord"), x["line"].alias("line_no"), x["text"].alias("text"))),
    )
    return files.select("cs_id", "file_ord", "path", F.explode(both).alias("l")).select("cs_id", "file_ord", "path", "l.side", F.col("l.ord").alias("line_ord"), "l.line_no", "l.text")


def file_lines(files: DataFrame, content: str, side: str) -> DataFrame:
    """A row for each line of a content: cs_id, file_ord, path, side, line_no, text."""
    return files.where(F.col(content).isNotNull()).select("cs_id", "file_ord", "path", F.lit(side).alias("side"), F.posexplode(lines_of(F.col(content))).alias("i", "text")).select("cs_id", "file_ord", "path", "side", (F.col("i") + 1).alias("line_no"), "text")


def by_path(files: DataFrame, path: str) -> DataFrame:
    """The first change of a path in each change set."""
    first = files.where(F.col("path") == path).groupBy("cs_id").agg(F.min("file_ord").alias("file_ord"))
    return files.where(F.col("path") == path).join(first, ["cs_id", "file_ord"], "left_semi")


def matching(files: DataFrame, *kinds: str) -> DataFrame:
    return files.where(F.col("kind").isin(*kinds))
