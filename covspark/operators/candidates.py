"""Rules for findings by technique, their verdicts, and what a finding shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import CLASS_CATEGORY, MOST_RULES
from ..shared import written
from ..sources.ruleset import Index
from .verdict import evidence, judge, label

KEY = ["src", "line", "rule_id"]


def level_rank(level: str) -> Column:
    low = F.lower(level)
    return F.when(low == "critical", 4).when(low == "high", 3).when(low == "medium", 2).when(low == "low", 1).otherwise(0)


def for_process(category: str = "category") -> Column:
    return (F.col(category) == "") | (F.lower(category) == "process_creation")


def for_class(kind: Column, category: str = "category") -> Column:
    out = F.lit(False)
    for name, own in CLASS_CATEGORY.items():
        out = out | ((kind == name) & (F.lower(category) == own))
    return out


def candidates(rows: DataFrame, index: Index, key: list[str] = KEY) -> DataFrame:
    """rows' key with each rule (candidate, title, level, category) that shares a technique exactly, once.

    A join on the technique, whose kind Spark picks by the size of the rules. Of rules with one id
    the first counts, in the order of the row's techniques.
    """
    wanted = rows.select(*key, F.posexplode("techniques").alias("pos", "t")).select(*key, "pos", F.col("t.id").alias("technique"))
    rules = index.by_technique.withColumnRenamed("rule_id", "candidate")
    found = wanted.join(rules, "technique")
    first = F.min(F.struct("pos", "file", "n", "title", "level", "category")).alias("c")
    return found.groupBy(*key, "candidate").agg(first).select(*key, "candidate", "c.title", "c.level", "c.category")


def verdicts(findings: DataFrame, asked: DataFrame, index: Index, platform: str, key: list[str] = KEY) -> DataFrame:
    """asked (key, candidate, ...) with verdict, NULL where a finding has no command or a rule no logic."""
    logic = {i: r for i, r in index.logic.items() if r}
    each = asked.groupBy(*key).agg(F.collect_set("candidate").alias("ids"))
    rows = evidence(findings.where(F.col("matched_command").isNotNull()).join(each, key), platform, "observed_event").select(*key, "ids", "process", "audit")
    judged = judge(rows, logic, "ids").withColumnRenamed("judged", "candidate").select(*key, "candidate", "verdict")
    return asked.join(judged, [*key, "candidate"], "left")


def verdict_rank(verdict: str = "verdict") -> Column:
    return F.when(F.col(f"{verdict}.outcome") == "fires", 0).when(F.col(f"{verdict}.outcome") == "no-fire", 2).otherwise(1)


def enrich(findings: DataFrame, index: Index, platform: str, most: int = MOST_RULES, before: bool = False) -> DataFrame:
    """findings whose claimed detections give way to candidate rules with verdicts, where there are any.

    The best `most` by verdict, then level, title and id are shown; with before, by
    level, title and id alone, and no other is judged. Findings are written once.
    """
    findings = written(findings)
    order = [F.desc(level_rank("level")), "title", "candidate"]

    def best(asked: DataFrame, *first: Column) -> DataFrame:
        nth = F.row_number().over(W.partitionBy(*KEY).orderBy(*first, *order))
        return asked.withColumn("nth", nth).where(F.col("nth") <= most)

    asked = candidates(findings, index)
    shown = verdicts(findings, best(asked), index, platform) if before else best(verdicts(findings, asked, index, platform), verdict_rank())
    text = F.when(F.col("verdict").isNotNull(), F.expr(label()))
    row = F.struct("nth", F.struct(F.lit("Sigma").alias("source"), F.format_string("%s (%s)", "title", "candidate").alias("rule"), F.col("level").alias("confidence"), text.alias("verdict")).alias("d"))
    lists = shown.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["d"]).alias("found"))
    return findings.join(lists, KEY, "left").withColumn("detections", F.coalesce("found", "detections")).drop("found")


