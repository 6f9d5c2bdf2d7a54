"""Answers to single questions, as dictionaries: what a tool server would return."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed import PRODUCT
from .operators.candidates import enrich
from .operators.kb import load
from .operators.rules import parse_rule
from .operators.verdict import evaluate, prepare
from .plans.analyze import predictive, report, script_units
from .sources.ruleset import Index

NOTE = "An answer of no finding is not evidence that an action is unseen."


def is_technique(text: str) -> bool:
    return re.fullmatch(r"T[0-9]{4}(\.[0-9]{3})?", text) is not None


def analyze_command(spark: SparkSession, command: str, platform: str, index: Index | None = None) -> dict:
    """The report of one command or script, its findings with rule verdicts if an index is given."""
    kb = load(platform)
    units = script_units(spark.createDataFrame([("command", command)], "src string, text string")).cache()
    findings = predictive(units, kb)
    if index:
        findings = enrich(findings, index, platform)
    row = report(findings, units, kb).first()
    out = row.asDict(True) if row else {"platform": platform, "note": kb.note, "findings": [], "max_noise": 0, "lines_analyzed": 0}
    return out | {"caveat": NOTE}


def technique_entries(table: DataFrame, wanted: str) -> DataFrame:
    """Entries of a technique or of its sub-techniques: T1059 holds T1059.004, not T10591."""
    return table.where(F.exists("techniques", lambda t: (t["id"] == wanted) | F.startswith(t["id"], F.lit(wanted + "."))))


def lookup_technique(spark: SparkSession, technique: str, platform: str | None = None) -> dict:
    if not is_technique(technique):
        raise ValueError(f"no technique id: {technique!r}")
    found = []
    for p in [platform] if platform else PRODUCT:
        rows = technique_entries(load(p).table(spark), technique).orderBy("rule_id").collect()
        found += [r.asDict(True) | {"platform": p} for r in rows]
    return {"technique": technique, "entries": found, "modeled": bool(found), "caveat": NOTE}


def evaluate_rule(spark: SparkSession, rule: str, command: str, platform: str) -> dict:
    """The verdict of one rule on the first command of a line; causes come with an unknown one, all of them."""
    parsed = parse_rule(rule)
    if parsed is None:
        return {"outcome": "indeterminate", "reason": "the rule's logic can't be read"}
    rows = evaluate(spark, parsed, command, platform).limit(1).collect()
    if not rows:
        return {"outcome": "indeterminate", "reason": "no command on the line"}
    return rows[0].verdict.asDict(True)


def describe_coverage(spark: SparkSession) -> list[dict]:
    """Entries and distinct techniques of each platform."""
    prepare(spark)
    out = []
    for p in PRODUCT:
        table = load(p).table(spark)
        row = table.select("rule_id", F.explode("techniques").alias("t")).agg(F.countDistinct("rule_id").alias("entries"), F.sort_array(F.collect_set("t.id")).alias("techniques")).first()
        out.append({"platform": p, "entries": row.entries, "techniques": row.techniques})
    return out


def check_rule(spark: SparkSession, rule: str, script: str, platform: str) -> DataFrame:
    """line, command, verdict of a rule on each command of each physical line of a script."""
    from .operators.verdict import evidence, judge

    parsed = parse_rule(rule)
    if parsed is None:
        raise ValueError("the rule's logic can't be read")
    units = script_units(spark.createDataFrame([("script", script)], "src string, text string"), logical=False)
    rows = units.select("line", F.explode("commands").alias("matched_command")).withColumn("asked", F.array(F.lit(parsed.id)))
    return judge(evidence(rows, platform), {parsed.id: parsed}, "asked").select("line", F.col("matched_command").alias("command"), "verdict")
