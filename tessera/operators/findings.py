"""Findings and scores: justification, order, and what is left of a change set's trust."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import GateConfig
from tessera.functions.dealing import growing
from tessera.schemas import SEVERITIES

BUDGET = 100


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def location(path: Column, evidence: Column) -> Column:
    """path:line of the first evidence, else the path."""
    first = F.get(evidence, F.lit(0))
    return F.coalesce(F.concat(first["path"], F.lit(":"), first["line"].cast("string")), path)


def effective_penalty(penalty: Column, justification: Column) -> Column:
    return F.when(justification.isNotNull(), 0).otherwise(penalty)


def checked(findings: DataFrame) -> DataFrame:
    """The same findings; a job that meets a negative penalty or evidence on a line below 1 fails."""
    bad_line = F.exists("evidence", lambda e: e["line"] < 1)
    penalty = F.when(F.col("penalty") < 0, F.raise_error(F.concat(F.lit("penalty must be non-negative, got "), F.col("penalty").cast("string"))).cast("int")).otherwise(F.col("penalty"))
    evidence = F.when(bad_line, F.raise_error(F.lit("evidence lines count from 1")).cast(findings.schema["evidence"].dataType)).otherwise(F.col("evidence"))
    return findings.withColumn("penalty", penalty).withColumn("evidence", evidence)


def _order() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.col("penalty").desc(), F.col("rule_id"), location(F.col("path"), F.col("evidence")), F.col("file_ord"), F.col("check_ord"), F.col("line_ord"), F.col("title")]


def in_order(findings: DataFrame) -> DataFrame:
    """Worst first: severity, penalty, rule, location as text, then the order in which they were found, at last the title."""
    return findings.orderBy("cs_id", *_order())


def placed(findings: DataFrame) -> DataFrame:
    """With `place`, the number from 1 of a finding in its change set's order; nothing is sorted over change sets."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("cs_id").orderBy(*_order())))


def trailers(messages: Column, config: GateConfig) -> Column:
    """An array of (rule_id, reason) from trailers `<name>: RULE - reason` of commit messages, in their order; null where no message holds the trailer's name."""
    pattern = rf"^\s*{re.escape(config.justification_trailer)}\s*:\s*([A-Za-z]+\d+)\s*(?:\x{{2014}}|\x{{2013}}|-+|:)\s*(\S.*?)\s*$"
    none = F.expr("cast(array() as array<string>)")
    of_name = F.filter(messages, lambda m: F.contains(m, F.lit(config.justification_trailer)))
    lines = F.flatten(F.transform(of_name, lambda m: F.coalesce(F.split(m, r"\r?\n"), none)))
    said = F.filter(F.coalesce(lines, none), lambda line: line.rlike(pattern))
    read = F.transform(said, lambda line: F.struct(F.upper(F.regexp_extract(line, pattern, 1)).alias("rule_id"), F.regexp_extract(line, pattern, 2).alias("reason")))
    return F.when(F.contains(F.array_join(messages, "\n"), F.lit(config.justification_trailer)), read)


def justifications(changesets: DataFrame, config: GateConfig) -> DataFrame:
    """(cs_id, rule_id, reason) from trailers; of several for a rule the last one's."""
    said = changesets.select("cs_id", F.posexplode(trailers(F.col("commit_messages"), config)).alias("at", "t"))
    return said.groupBy("cs_id", F.col("t.rule_id").alias("rule_id")).agg(F.max_by("t.reason", "at").alias("reason"))


def justify(findings: DataFrame, reasons: DataFrame, config: GateConfig) -> DataFrame:
    """Findings with the reason given for their rule; evidence stays, the penalty no longer counts."""
    if not config.allow_justification:
        return findings
    return findings.join(growing(reasons), ["cs_id", "rule_id"], "left").withColumn("justification", F.coalesce("reason", "justification")).drop("reason").select(*findings.columns)


def band(value: Column, threshold: Column) -> Column:
    """90 is tested before the threshold."""
    return F.when(value >= 90, "trusted").when(value >= threshold, "acceptable").when(value >= 40, "suspect").otherwise("untrusted")


def summary(value: Column, band_: Column, n: Column) -> Column:
    rest = F.when(n == 0, "no verification loss detected").otherwise(F.concat(n.cast("string"), F.lit(" unjustified "), F.when(n == 1, "finding").otherwise("findings")))
    return F.concat(F.lit("Trust "), value.cast("string"), F.lit("/100 ("), band_, F.lit(") — "), rest)


def scores(changesets: DataFrame, findings: DataFrame, config: GateConfig) -> DataFrame:
    """A row for each change set, those without findings too: value, threshold, passed, band, worst_severity, n_unjustified, summary."""
    open_ = F.col("justification").isNull()
    spent = findings.groupBy("cs_id").agg(
        F.sum(effective_penalty(F.col("penalty"), F.col("justification"))).alias("spent"), F.count_if(open_).alias("n_unjustified"),
        F.max(F.when(open_, severity_rank(F.col("severity")))).alias("rank"),
    )
    return _scored(changesets.select("cs_id").join(growing(spent), "cs_id", "left"), config).select(*SCORE)


SCORE = ("cs_id", "value", "threshold", "n_unjustified", "worst_severity", "passed", "band", "summary")


def _scored(rows: DataFrame, config: GateConfig) -> DataFrame:
    """Rows with their score, from what was spent, the number of unjustified findings and the highest rank among them."""
    value, threshold = F.greatest(F.lit(0), BUDGET - F.coalesce("spent", F.lit(0))).cast("int"), F.lit(config.fail_under)
    rows = rows.withColumns({"value": value, "threshold": threshold, "n_unjustified": F.coalesce("n_unjustified", F.lit(0).cast("long")), "worst_severity": F.get(F.array(*map(F.lit, SEVERITIES)), F.col("rank"))})
    rows = rows.withColumns({"passed": F.col("value") >= F.col("threshold"), "band": band(F.col("value"), F.col("threshold"))}).drop("spent", "rank")
    return rows.withColumn("summary", summary(F.col("value"), F.col("band"), F.col("n_unjustified")))


#: A finding in its change set's row, as `judged` nests it.
NESTED = "struct<place:int,rule_id:string,severity:string,penalty:int,title:string,detail:string,location:string,justification:string>"


def judged(changesets: DataFrame, findings: DataFrame, config: GateConfig) -> DataFrame:
    """A row for each change set, with all its columns, its score and its findings nested in order. What `justify`, `scores` and `placed` say in
    four shuffles or sorts of findings: here they are gathered once and meet their change set once, which holds the reasons."""
    at = location(F.col("path"), F.col("evidence"))
    # As plain structs are ordered: worst first, like _order.
    one = F.struct(
        (-severity_rank(F.col("severity"))).alias("rank"), (-F.col("penalty")).alias("less"), "rule_id", at.alias("location"), "file_ord", "check_ord", "line_ord", "title", "severity", "penalty", "detail", "justification",
    )
    gathered = findings.groupBy("cs_id").agg(F.sort_array(F.collect_list(one)).alias("found"))
    rows = changesets.withColumn("said", trailers(F.col("commit_messages"), config)).join(growing(gathered), "cs_id", "left")

    def nested(x: Column, i: Column) -> Column:
        reason = F.when(F.col("said").isNotNull(), F.try_element_at(F.filter("said", lambda t: t["rule_id"] == x["rule_id"]), F.lit(-1))["reason"])
        why = F.coalesce(reason, x["justification"]) if config.allow_justification else x["justification"]
        return F.struct((i + 1).alias("place"), x["rule_id"], x["severity"], x["penalty"], x["title"], x["detail"], x["location"], why.alias("justification"))

    rows = rows.withColumn("findings", F.coalesce(F.when(F.col("found").isNotNull(), F.transform("found", nested)), F.expr("array()")).cast(f"array<{NESTED}>")).drop("said", "found")
    rows = rows.withColumn("open", F.when(F.size("findings") > 0, F.filter("findings", lambda x: x["justification"].isNull())))
    some = F.size("open") > 0
    rows = rows.withColumns({
        "spent": F.when(some, F.aggregate("open", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["penalty"])), "n_unjustified": F.when(some, F.size("open").cast("long")),
        "rank": F.when(some, F.array_max(F.transform("open", lambda x: severity_rank(x["severity"])))),
    })
    return _scored(rows.drop("open"), config)


def write(result: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Findings or scores to a folder, a file for each partition; JSON keeps the nested evidence too."""
    result.write.mode("overwrite").format(format).save(path)
