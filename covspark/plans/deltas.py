"""This run against a saved one: findings, coverage and verified claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coverage import RANK

STATUS_RANK = {"unverified": 0, "removed": 0, "no-rule": 1, "not-applicable": 1, "indeterminate": 2, "verified": 3}


def strongest(detections: str = "detections") -> Column:
    """The first word of the strongest verdict among detections, NULL if none has one."""
    words = F.transform(F.filter(detections, lambda d: d["verdict"].isNotNull()), lambda d: F.element_at(F.split(F.trim(d["verdict"]), "\\s+"), 1))
    ranked = F.transform(words, lambda w: F.struct(F.when(w == "fires", 3).when(w == "indeterminate", 2).when(w == "no-fire", 1).otherwise(0).alias("r"), w.alias("w")))
    return F.array_max(ranked)["w"]


def loudest(findings: DataFrame) -> DataFrame:
    """A row a rule: of its findings the loudest, the first of equals (pos)."""
    best = F.max_by(F.struct("description", "techniques", "noise", "severity", "verdict"), F.struct("noise", -F.col("pos")))
    return findings.withColumn("verdict", strongest()).groupBy("rule_id").agg(best.alias("b")).select("rule_id", "b.*")


def findings_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """rule_id, change (added, removed, changed), before, after: full outer join of collapsed runs.

    Both have pos, rule_id, description, techniques, noise, severity, detections.
    """
    side = lambda df, name: loudest(df).select("rule_id", F.struct("description", "techniques", "noise", "severity", "verdict").alias(name))
    both = side(baseline, "before").join(side(current, "after"), "rule_id", "full")
    differs = (F.col("before.noise") != F.col("after.noise")) | ~F.col("before.verdict").eqNullSafe(F.col("after.verdict"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(differs, "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").orderBy("change", F.desc(F.coalesce("after.noise", "before.noise")), "rule_id")


def trend(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: findings and peak noise of both runs, louder, quieter."""
    side = lambda df, name: df.agg(F.count("*").alias(f"{name}_findings"), F.coalesce(F.max("noise"), F.lit(0)).alias(f"{name}_max_noise"))
    both = side(baseline, "baseline").crossJoin(side(current, "current"))  # one row each
    return both.withColumns({"louder": F.expr("current_max_noise > baseline_max_noise"), "quieter": F.expr("current_max_noise < baseline_max_noise")})


def _ranked(column: str, ranks: dict[str, int]) -> Column:
    out = F.lit(-1)
    for name, r in ranks.items():
        out = F.when(F.col(column) == name, r).otherwise(out)
    return out


def best_coverage(results: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("description", "techniques", "coverage"), F.struct(_ranked("coverage", RANK), -F.col("pos")))
    return results.groupBy("rule_id").agg(best.alias("b")).select("rule_id", "b.*")


def coverage_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """rule_id, change (closed, opened, changed, added, removed), before, after. Both have pos, rule_id, description, techniques, coverage."""
    old, new = (best_coverage(df).select("rule_id", F.struct("description", "techniques", "coverage").alias(name)) for df, name in ((baseline, "before"), (current, "after")))
    b, a = F.col("before.coverage"), F.col("after.coverage")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(a == b, None).when(a == "covered", "closed").when(b == "covered", "opened").otherwise("changed")
    return old.join(new, "rule_id", "full").withColumn("change", change).where("change IS NOT NULL").orderBy("change", "rule_id")


def coverage_gate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: gaps and covered rules of both runs, and whether coverage regressed."""
    side = lambda df, n: best_coverage(df).agg(F.count_if(F.col("coverage") == "gap").alias(f"{n}_gaps"), F.count_if(F.col("coverage") == "covered").alias(f"{n}_covered"))
    opened = coverage_delta(baseline, current).agg(F.count_if(F.col("change") == "opened").alias("opened"))
    both = side(baseline, "baseline").crossJoin(side(current, "current")).crossJoin(opened)  # one row each
    return both.withColumn("regressed", F.expr("opened > 0 OR current_gaps > baseline_gaps"))


def verify_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """id, change (regression, improvement, introduced), before, after. Both have id, description, status.

    A verified claim that is gone regressed, to `removed`; any other that is gone did not.
    """
    old = baseline.select("id", F.col("description").alias("was"), F.col("status").alias("before"))
    both = old.join(current.select("id", "description", F.col("status").alias("after")), "id", "full")
    gone = F.col("after").isNull()
    b, a = _ranked("before", STATUS_RANK), _ranked("after", STATUS_RANK)
    change = F.when(F.col("before").isNull(), "introduced").when(gone & (F.col("before") == "verified"), "regression").when(~gone & (a < b), "regression").when((F.col("before") != "verified") & (F.col("after") == "verified"), "improvement")
    both = both.withColumn("change", change).where("change IS NOT NULL")
    both = both.select("id", "change", F.coalesce("description", "was").alias("description"), "before", F.coalesce("after", F.lit("removed")).alias("after"))
    return both.orderBy("change", F.when(F.col("change") == "introduced", _ranked("after", STATUS_RANK)).otherwise(0), "id")


def verify_gate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: counts of both runs, and whether the gate fails, and why."""
    side = lambda df, n: df.agg(*(F.count_if(F.col("status") == s).alias(f"{n}_{s}") for s in ("verified", "unverified")))
    delta = verify_delta(baseline, current)
    what = delta.agg(F.count_if(F.col("change") == "regression").alias("regressions"), F.count_if((F.col("change") == "introduced") & (F.col("after") == "unverified")).alias("refuted"))
    both = side(baseline, "baseline").crossJoin(side(current, "current")).crossJoin(what)  # one row each
    reason = F.concat_ws(
        "; ",
        F.when(F.col("regressions") > 0, F.concat("regressions", F.lit(" detection(s) got worse than the baseline"))),
        F.when(F.col("refuted") > 0, F.concat("refuted", F.lit(" new claim(s) the ruleset does not substantiate"))),
        F.when(F.col("current_unverified") > F.col("baseline_unverified"), F.concat(F.lit("the unverified count rose from "), "baseline_unverified", F.lit(" to "), "current_unverified")),
    )
    return both.withColumns({"fails": reason != "", "reason": reason})
