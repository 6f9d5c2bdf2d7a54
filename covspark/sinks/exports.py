"""Reports as JSON documents, one row a source, built by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOL, VERSION, HOME = "covspark", "0.1.0", "https://attack.mitre.org"
SARIF = "https://json.schemastore.org/sarif-2.1.0.json"
ATTACK = "https://attack.mitre.org/techniques/"


def attack_url(technique: Column) -> Column:
    return F.concat(F.lit(ATTACK), F.replace(technique, F.lit("."), F.lit("/")))


def report_json(reports: DataFrame) -> DataFrame:
    """src, json of reports; empty lists of vendor events and side effects are left out."""
    slim = F.transform("findings", lambda f: f.withField("observed_side_effects", F.when(F.size(f["observed_side_effects"]) > 0, f["observed_side_effects"])))
    whole = F.struct("platform", "note", slim.alias("findings"), "max_noise", "lines_analyzed")
    return reports.select("src", F.to_json(whole, {"ignoreNullFields": "true"}).alias("json"))


def rows_json(results: DataFrame, head: dict[str, Column], order: list[str]) -> DataFrame:
    """One document of results (a row each) under a head, as coverage and verify runs are saved."""
    kept = [c for c in results.columns if c not in ("src", "noise")]
    row = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)), F.struct(*kept).alias("r"))
    listed = results.agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("results"))
    return listed.select(F.to_json(F.struct(*(c.alias(n) for n, c in head.items()), "results")).alias("json"))


def security_severity(noise: Column) -> Column:
    return F.format_number(noise / 10, 1)


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "critical", "error").when(severity == "high", "warning").otherwise("note")


def sarif(reports: DataFrame) -> DataFrame:
    """src, json: a SARIF 2.1.0 log of each report; a rule once, where it is first seen."""
    text = lambda c: F.struct(c.alias("text"))
    ids = F.transform("findings", lambda f: f["rule_id"])
    firsts = F.filter("findings", lambda f, i: F.array_position(ids, f["rule_id"]) == i + 1)

    def rule(f: Column) -> Column:
        names = F.array_join(F.transform(f["techniques"], lambda t: F.concat(t["id"], F.lit(" "), t["name"])), "; ")
        full = F.when(F.size(f["techniques"]) == 0, f["description"]).otherwise(F.concat(f["description"], F.lit(" (ATT&CK: "), names, F.lit(")")))
        tags = F.concat(F.array(F.lit("security"), F.lit("att&ck")), F.transform(f["techniques"], lambda t: t["id"]))
        props = F.struct(tags.alias("tags"), security_severity(f["noise"]).alias("security-severity"))
        return F.struct(f["rule_id"].alias("id"), f["rule_id"].alias("name"), text(f["description"]).alias("shortDescription"), text(full).alias("fullDescription"), attack_url(F.get(f["techniques"], 0)["id"]).alias("helpUri"), props.alias("properties"))

    def result(f: Column, src: Column) -> Column:
        techniques = F.array_join(F.transform(f["techniques"], lambda t: F.concat(F.lit("\nATT&CK: "), t["id"], F.lit(" "), t["name"])), "")
        found = F.array_join(F.transform(f["detections"], lambda d: F.concat(F.lit("\nDetection: "), d["source"], F.lit(": "), d["rule"], F.lit(" ("), d["confidence"], F.lit(" confidence)"))), "")
        message = F.concat(f["description"], techniques, found, F.lit("\nDetectability: "), f["noise"], F.lit(" ("), f["severity"], F.lit(")"))
        place = F.struct(F.struct(F.struct(src.alias("uri")).alias("artifactLocation"), F.struct(F.greatest(f["line"], F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
        return F.struct(f["rule_id"].alias("ruleId"), sarif_level(f["severity"]).alias("level"), text(message).alias("message"), F.array(place).alias("locations"))

    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"), F.lit(HOME).alias("informationUri"), F.transform(firsts, rule).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("findings", lambda f: result(f, F.col("src"))).alias("results"))
    return reports.select("src", F.to_json(F.struct(F.lit(SARIF).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("json"))


def technique_scores(findings: DataFrame, key: list[str]) -> DataFrame:
    """key, technique, score (the loudest), comment (a line a finding), first: in the order of findings (pos)."""
    each = findings.select(*key, "pos", "line", "rule_id", "description", "noise", F.posexplode("techniques").alias("t", "technique"))
    line = F.struct("pos", "t", F.concat(F.lit("L"), "line", F.lit(" "), "rule_id", F.lit(": "), "description").alias("text"))
    return each.groupBy(*key, F.col("technique.id").alias("technique")).agg(F.max("noise").alias("score"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["text"]), "\n").alias("comment"), F.min(F.struct("pos", "t")).alias("first"))


def navigator(reports: DataFrame) -> DataFrame:
    """src, json: an ATT&CK Navigator layer of each report."""
    rows = reports.select("src", "platform", F.posexplode("findings").alias("pos", "f")).select("src", "platform", "pos", "f.line", "f.rule_id", "f.description", "f.noise", "f.techniques")
    scores = technique_scores(rows, ["src", "platform"])
    entry = F.struct("first", F.struct(F.col("technique").alias("techniqueID"), "score", F.lit("").alias("color"), "comment", F.lit(True).alias("enabled")).alias("e"))
    listed = scores.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("techniques"))
    layer = F.struct(
        F.concat(F.lit(f"{TOOL} — "), "platform").alias("name"),
        F.struct(F.lit("16").alias("attack"), F.lit("4.9.5").alias("navigator"), F.lit("4.5").alias("layer")).alias("versions"),
        F.lit("enterprise-attack").alias("domain"),
        F.concat(F.lit(f"{TOOL} detection-coverage layer ("), "platform", F.lit("). Score = detectability: 0 quiet, 100 loud.")).alias("description"),
        F.coalesce("techniques", F.array().cast(listed.schema["techniques"].dataType)).alias("techniques"),
        F.struct(F.array(*map(F.lit, ("#fff7b0", "#ffb066", "#f7768e"))).alias("colors"), F.lit(0).alias("minValue"), F.lit(100).alias("maxValue")).alias("gradient"),
        F.lit(3).alias("sorting"),
        F.lit(False).alias("hideDisabled"),
    )
    return reports.select("src", "platform").join(listed, "src", "left").select("src", F.to_json(layer).alias("json"))
