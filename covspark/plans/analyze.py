"""Findings: what the knowledge base sees in scripts and in recorded telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shell import COMMANDS, commands_sql, lines_column, substitutions_column
from ..functions.sql import trim
from ..operators.kb import KnowledgeBase, match_events, match_units
from ..operators.verdict import prepare
from ..sources.telemetry import Ingest

EFFECTS = "array<struct<class:string,detail:string>>"
COLUMNS = ["src", "line", "source", "rule_id", "description", "techniques", "telemetry", "detections", "observed_side_effects", "noise", "severity", "matched_command", "observed_event"]


def script_units(scripts: DataFrame, logical: bool = True) -> DataFrame:
    """src, line, raw, commands of each line of scripts (src, text) that is neither blank nor a comment.

    logical: lines are joined and here-documents read (by Python, a script at a
    time); the commands inside substitutions come after a line's own. Otherwise
    lines are physical ones and everything stays in SQL.
    """
    prepare(scripts.sparkSession)
    lines = scripts.select("src", F.explode(lines_column(F.col("text"))).alias("u")).select("src", "u.line", "u.text") if logical else scripts.select("src", F.posexplode(F.split("text", "\r?\n")).alias("n", "text")).selectExpr("src", "n + 1 AS line", "text")
    lines = lines.withColumn("raw", F.expr(trim("text"))).where("raw <> '' AND NOT startswith(raw, '#')")
    own = lines.withColumn("commands", F.expr(commands_sql("text")))
    if logical:
        inner = F.transform(substitutions_column(F.col("text")), lambda s: s)
        own = own.withColumn("inner", inner).withColumn("commands", F.expr(f"concat(commands, flatten(transform(inner, s -> {commands_sql('s')})))"))
    return own.select("src", F.col("line").cast("bigint").alias("line"), "raw", "commands")


def predictive(units: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Findings of script units; source is the line itself."""
    found = match_units(units, kb)
    return found.withColumns({"source": F.col("raw"), "observed_side_effects": F.array().cast(EFFECTS), "observed_event": F.lit(None).cast("map<string,string>")}).select(*COLUMNS)


def observed(ingest: Ingest, kb: KnowledgeBase) -> DataFrame:
    """Findings of telemetry: executions by their commands, lone events by their fields."""
    units = ingest.observations.withColumn("raw", F.expr(trim("raw")))
    runs = match_units(units, kb, from_raw=False).withColumns({"line": F.col("record").cast("bigint"), "source": F.col("raw"), "observed_side_effects": F.col("side_effects"), "observed_event": F.col("fields")}).select(*COLUMNS)
    alone = match_events(ingest.events, kb).withColumns(
        {"line": F.col("record").cast("bigint"), "source": F.col("detail"), "observed_side_effects": F.array(F.struct("class", "detail")).cast(EFFECTS), "matched_command": F.lit(None).cast(COMMANDS[6:-1]), "observed_event": F.col("fields")}
    )
    return runs.unionByName(alone.select(*COLUMNS))


def ordered(findings: DataFrame) -> DataFrame:
    """Loudest first, then by line and rule."""
    return findings.orderBy("src", F.desc("noise"), "line", "rule_id")


def report(findings: DataFrame, units: DataFrame, kb: KnowledgeBase, least: int = 0) -> DataFrame:
    """src, platform, note, findings, max_noise, lines_analyzed: a row a source.

    least hides quieter findings but not from max_noise, so a gate still sees them.
    """
    kept = [c for c in COLUMNS if c not in ("src", "matched_command", "observed_event")]
    # the sort key leads the struct; what follows breaks no tie, as a source has a rule once a line
    row = F.struct((-F.col("noise")).alias("k"), F.col("line").alias("l"), F.col("rule_id").alias("r"), F.struct(*kept).alias("f"))
    found = findings.groupBy("src").agg(F.sort_array(F.collect_list(F.when(F.col("noise") >= least, row))).alias("rows"), F.max("noise").alias("max_noise"))
    lines = units.groupBy("src").agg(F.count("*").alias("lines_analyzed"))
    whole = lines.join(found, "src", "left")
    none = F.array().cast(whole.schema["rows"].dataType)
    return whole.select("src", F.lit(kb.platform).alias("platform"), F.lit(kb.note).alias("note"), F.transform(F.coalesce("rows", none), lambda x: x["f"]).alias("findings"), F.coalesce("max_noise", F.lit(0)).alias("max_noise"), "lines_analyzed")
