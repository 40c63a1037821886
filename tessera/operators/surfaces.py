"""Surfaces of both sides of changed test files, with the four states that must not be confused."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessera.config import GateConfig
from tessera.functions.paths import EXTRACTORS, detect_language, is_test_path
from tessera.operators.python_surface import captures, extract
from tessera.schemas import SURFACE, TEST

_COLUMNS = ["cs_id", "file_ord", "path", "side", "status", "language", "framework", "parse_ok", "parse_error", "tests"]
_SCHEMA = f"cs_id long, file_ord int, path string, side string, {SURFACE}"


def extract_sources(sources: DataFrame) -> DataFrame:
    """Surfaces of rows (cs_id, file_ord, path, side, content). Contents stay with their task."""

    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(_SCHEMA)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            own = [b.column(name) for name in _COLUMNS[:4]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([x[name] for x in found], kinds[name]) for name in _COLUMNS[4:])], names=_COLUMNS)

    keys = [F.col(name).cast(kind) for name, kind in (("cs_id", "long"), ("file_ord", "int"), ("path", "string"), ("side", "string"))]
    return sources.select(*keys, "content").mapInArrow(run, _SCHEMA)


def surfaces(files: DataFrame, config: GateConfig | None = None) -> DataFrame:
    """A row for each change and side: the surface, or why there is none. Gates are expressions on the path of the
    head side (a renamed file is read under it on both), so only sources that need it reach Python."""
    config = config or GateConfig()
    sides = F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base_content").alias("content")), F.struct(F.lit("head").alias("side"), F.col("head_content").alias("content"))))
    language = detect_language(F.col("path"))
    rows = files.select("cs_id", "file_ord", "path", "kind", language.alias("language"), (~F.col("is_binary") & is_test_path(F.col("path"), config) & F.coalesce(language.isin(*EXTRACTORS), F.lit(False))).alias("readable"), sides.alias("s"))
    rows = rows.select("*", "s.side", "s.content")
    gone = ((F.col("side") == "base") & (F.col("kind") == "added")) | ((F.col("side") == "head") & (F.col("kind") == "deleted"))
    state = F.when(~F.col("readable"), "not_applicable").when(F.col("content").isNotNull(), "source").when(gone, "absent").otherwise("unknown")
    rows = rows.withColumn("status", state)
    empty = F.col("status") == "absent"
    others = rows.where(F.col("status") != "source").select(
        "cs_id", "file_ord", "path", "side", "status", F.when(empty, F.col("language")).alias("language"), F.when(empty, F.lit("")).alias("framework"),
        F.when(empty, F.lit(True)).alias("parse_ok"), F.lit(None).cast("string").alias("parse_error"), F.when(empty, F.expr(f"cast(array() as array<{TEST}>)")).alias("tests"),
    )
    return extract_sources(rows.where(F.col("status") == "source")).unionByName(others)


def capture_rows(sources: DataFrame, kind: str) -> DataFrame:
    """(cs_id, path, capture, text, line) for nodes of one kind in sources (cs_id, path, content); sources that can't be parsed give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cs, path, content in zip(b["cs_id"], b["path"], b["content"], strict=True):
                try:
                    rows += [(cs, path, *c) for c in captures(content, kind)]
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
            yield pd.DataFrame(rows, columns=["cs_id", "path", "capture", "text", "line"])

    return sources.select("cs_id", "path", "content").mapInPandas(run, "cs_id long, path string, capture string, text string, line int")
