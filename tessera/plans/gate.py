"""The gate: from change sets and file changes to findings and one score each.

One plan serves any number of change sets. Python is met twice, reading diffs and extracting
surfaces; everything between is Catalyst, with cs_id and path as keys all along. A file (cs_id, file_ord, path) is
one row of the files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import GateConfig
from tessera.operators.findings import checked, judged, justifications, justify, scores
from tessera.operators.rules import Context, Rule, discover, findings
from tessera.operators.surfaces import surfaces

#: Rules of the implemented specification; the others extend it.
CORE = ("VID009", "VID010")


@dataclass(frozen=True)
class Result:
    findings: DataFrame
    scores: DataFrame
    context: Context
    changesets: DataFrame
    raw: DataFrame

    def judged(self) -> DataFrame:
        """Both at once: a row for each change set, its own columns, its score, and its findings nested in order."""
        return judged(self.changesets, self.raw, self.context.config)

    def release(self) -> None:
        """To be called once both were read: gives back what the plan kept for its rules."""
        self.context.release()


def gate(changesets: DataFrame, files: DataFrame, config: GateConfig | None = None, *, rules: tuple[str, ...] = CORE, keep: bool = True) -> Result:
    """Findings and scores of change sets whose diffs could be parsed; the others are left out and keep their parse_error.
    With `keep`, what several rules read is kept until release()."""
    config = config or GateConfig()
    chosen: tuple[Rule, ...] = tuple(r for r in discover() if r.id in rules)
    need = any(r.id not in CORE for r in chosen)
    context = Context(files, config, surfaces(files, config) if need else None, keep=keep)
    found = findings(context, chosen)
    good = changesets.where(F.col("parse_error").isNull())
    if found is None:
        from tessera.schemas import FINDINGS

        found = changesets.sparkSession.createDataFrame([], FINDINGS)
    raw = checked(found)
    found = justify(raw, justifications(good, config), config)
    return Result(found, scores(good, found, config), context, good, raw)
