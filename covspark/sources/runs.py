"""Saved runs: what sinks wrote, read back with a fixed schema; absent lists are empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "struct<line:bigint,source:string,rule_id:string,description:string,techniques:array<struct<id:string,name:string>>,telemetry:array<string>,detections:array<struct<source:string,rule:string,confidence:string,verdict:string>>,edr:array<struct<vendor:string,events:array<string>>>,observed_side_effects:array<struct<class:string,detail:string>>,noise:int,severity:string>"
REPORT = f"platform string, note string, findings array<{FINDING}>, max_noise int, lines_analyzed bigint"
COVERAGE = "platform string, rules_indexed bigint, results array<struct<line:bigint,rule_id:string,description:string,techniques:array<string>,coverage:string,firing:array<string>>>"
VERIFY = "platform string, sigma_ref string, rules_indexed bigint, results array<struct<id:string,description:string,techniques:array<string>,claimed:array<string>,status:string,firing:array<string>,not_firing:array<string>,because:struct<modifiers:array<string>,missing_fields:array<string>,partial_fields:array<string>,unparsed_rules:bigint,inapplicable_rules:bigint,null_value_match:boolean,no_representative:boolean>>>"
KINDS = {"report": (REPORT, "findings"), "coverage": (COVERAGE, "results"), "verify": (VERIFY, "results")}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The one row of a saved run."""
    schema, inner = KINDS[kind]
    whole = spark.read.schema(schema).json(path, multiLine=True)
    return whole.withColumn(inner, F.coalesce(inner, F.array().cast(whole.schema[inner].dataType)))


def rows(run: DataFrame, kind: str) -> DataFrame:
    """Its findings or results, in the order in which they were saved: pos and their own columns."""
    return run.select("platform", F.posexplode(KINDS[kind][1]).alias("pos", "r")).select("platform", "pos", "r.*")
