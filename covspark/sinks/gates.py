"""One boolean of a run, as a process's exit code: 0 passed, 1 failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 50


def loud(reports: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """fails: a finding, shown or hidden, is as loud as the threshold."""
    return reports.agg(F.coalesce(F.max("max_noise") >= threshold, F.lit(False)).alias("fails"))


def gaps(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.coalesce(F.max(F.col("coverage") == "gap"), F.lit(False)).alias("fails"))


def unverified(claims: DataFrame) -> DataFrame:
    return claims.agg(F.coalesce(F.max(F.col("status") == "unverified"), F.lit(False)).alias("fails"))


def exit_code(gate: DataFrame) -> int:
    return int(gate.first()["fails"])
