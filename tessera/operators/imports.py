"""Names that Python files bind by imports, and what a dotted name stands for.

A file is known by the dotted names under which it can be imported; what an import binds is an edge
from (module, name) to another dotted name. To resolve a name is to join its prefixes with the edges,
as often as names are handed on from module to module.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dealing import growing
from tessera.functions.paths import detect_language, normalized

#: Folders that hold packages and are no part of their names.
ROOTS = ("src", "lib")


def module_names(path: Column) -> Column:
    """The dotted names of a Python file: by its whole path, and by its path below a folder of ROOTS."""
    bare = F.regexp_replace(F.regexp_replace(normalized(path), r"\.pyi?$", ""), r"(^|/)__init__$", "")
    whole = F.translate(bare, "/", ".")
    below = F.regexp_replace(whole, rf"^(?:{'|'.join(ROOTS)})\.", "")
    return F.array_remove(F.array_distinct(F.array(whole, below)), "")


def imports_of(source: str, package: str) -> list[tuple[str, str]]:
    """(name, what it stands for) of a source's imports, wherever they stand; `package` is where relative ones begin. Sources that can't be read give none."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in nodes:
        if isinstance(node, ast.Import):
            out += [(a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0]) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            above = package.split(".")[: len(package.split(".")) - (node.level - 1)] if node.level else []
            origin = ".".join(x for x in (*above, node.module) if x)
            out += [(a.asname or a.name, f"{origin}.{a.name}" if origin else a.name) for a in node.names if a.name != "*"]
    return out


def import_edges(files: DataFrame) -> DataFrame:
    """(cs_id, file_ord, path, module, name, stands_for) of the head sides of Python files, once for each name of the module."""
    wanted = files.where(~F.col("is_binary") & F.col("head_content").isNotNull() & (detect_language(F.col("path")) == "python"))
    rows = wanted.select("cs_id", "file_ord", "path", F.explode(module_names(F.col("path"))).alias("module"), normalized(F.col("path")).rlike(r"(^|/)__init__\.pyi?$").alias("package"), "head_content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for r in b.itertuples(index=False):
                home = r.module if r.package else r.module.rpartition(".")[0]
                found += [(r.cs_id, r.file_ord, r.path, r.module, *x) for x in imports_of(r.head_content, home)]
            yield pd.DataFrame(found, columns=["cs_id", "file_ord", "path", "module", "name", "stands_for"])

    return rows.mapInPandas(run, "cs_id long, file_ord int, path string, module string, name string, stands_for string").distinct()


def _after(segments: Column, n: Column) -> Column:
    return F.slice(segments, n + 1, F.greatest(F.size(segments) - n, F.lit(0)))


def prefixes(names: DataFrame, name: str = "resolved") -> DataFrame:
    """`names` once for each proper prefix: module, the next segment, and the rest after it."""
    parts = F.split(name, r"\.")
    rows = names.withColumn("parts", parts).where(F.size("parts") > 1).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)))
    n = F.col("n")
    return rows.select(*names.columns, F.array_join(F.slice("parts", F.lit(1), n), ".").alias("module"), F.get("parts", n).alias("name"), _after(F.col("parts"), n + 1).alias("rest"))


def handed_on(names: DataFrame, edges: DataFrame, *, hops: int = 3) -> DataFrame:
    """`names` (with cs_id, resolved) and all that they stand for after up to `hops` modules have handed them on; a name may come more than
    once. Each hop is one join: names that were found before go through it unmatched, so that `names` is read once."""
    known = growing(edges.select("cs_id", "module", "name", "stands_for"))
    parts = F.split("resolved", r"\.")
    out = names.withColumn("_new", F.lit(True))
    for _ in range(hops):
        # The name itself (n is 0), and each proper prefix of a new one.
        cuts = F.when(F.col("_new") & (F.size(parts) > 1), F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array(F.lit(0)))
        each = out.withColumn("_n", F.explode(cuts)).withColumn("_parts", parts)
        n, found = F.col("_n"), F.col("_n") > 0
        each = each.withColumn("module", F.when(found, F.array_join(F.slice("_parts", F.lit(1), n), "."))).withColumn("name", F.when(found, F.get("_parts", n)))
        met = each.join(known, ["cs_id", "module", "name"], "left").where("_n = 0 or stands_for is not null")
        on = F.when(found, F.array_join(F.concat(F.array("stands_for"), _after(F.col("_parts"), n + 1)), ".")).otherwise(F.col("resolved"))
        out = met.select(*[on.alias(c) if c == "resolved" else F.col(c) for c in names.columns], found.alias("_new"))
    return out.drop("_new")
