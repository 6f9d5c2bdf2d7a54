"""Coverage: for each finding, whether a rule would fire on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import MOST_FIRING
from ..operators.candidates import KEY, candidates, for_process, level_rank, verdicts
from ..shared import written
from ..sources.ruleset import Index

RANK = {"no-rules": 0, "gap": 1, "indeterminate": 2, "covered": 3}


def rank(status: str) -> Column:
    out = F.lit(0)
    for name, r in RANK.items():
        out = F.when(F.col(status) == name, r).otherwise(out)
    return out


def coverage(findings: DataFrame, index: Index, platform: str) -> DataFrame:
    """src, line, rule_id, description, techniques, coverage, firing, noise.

    covered: a candidate for process executions fires. indeterminate: none does and one
    can't be told, which holds for every candidate of a finding without a command.
    gap: all say no. no-rules: there is no candidate. Findings are written once, as
    candidates, evidence and results each read them.
    """
    findings = written(findings)
    asked = verdicts(findings, candidates(findings, index).where(for_process()), index, platform)
    outcome = F.coalesce(F.col("verdict.outcome"), F.lit("indeterminate"))
    order = F.struct((-level_rank("level")).alias("l"), "title", "candidate")
    fired = F.sort_array(F.collect_list(F.when(outcome == "fires", order)))
    found = asked.groupBy(*KEY).agg(F.max(F.when(outcome == "fires", 3).when(outcome == "indeterminate", 2).otherwise(1)).alias("best"), F.transform(fired, lambda x: x["title"]).alias("firing"))
    status = F.when(F.col("best") == 3, "covered").when(F.col("best") == 2, "indeterminate").when(F.col("best") == 1, "gap").otherwise("no-rules")
    return findings.join(found, KEY, "left").select(*KEY, "description", F.transform("techniques", lambda t: t["id"]).alias("techniques"), status.alias("coverage"), F.coalesce("firing", F.array().cast("array<string>")).alias("firing"), "noise")


def summary(firing: str = "firing") -> Column:
    """The first titles of a list, and how many more there are."""
    n = F.size(firing)
    return F.concat(F.array_join(F.slice(F.col(firing), 1, MOST_FIRING), "; "), F.when(n > MOST_FIRING, F.concat(F.lit("; +"), n - MOST_FIRING, F.lit(" more"))).otherwise(""))


def counts(results: DataFrame, status: str = "coverage") -> DataFrame:
    return results.groupBy(status).agg(F.count("*").alias("n"))
