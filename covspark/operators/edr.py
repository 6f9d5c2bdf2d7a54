"""What vendors' sensors report for the telemetry that a finding describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import TELEMETRY_CLASSES
from ..fixed_vendors import ALIASES, EVENTS, VENDORS


def line_class(line: Column) -> Column:
    """The class of a described event: the first in order any of whose patterns is in it; NULL if none is."""
    low = F.lower(line)
    out = F.lit(None).cast("string")
    for name, patterns in reversed(TELEMETRY_CLASSES):
        test = F.lit(False)
        for p in patterns:
            test = test | F.contains(low, F.lit(p))
        out = F.when(test, name).otherwise(out)
    return out


def classes(telemetry: Column) -> Column:
    """Distinct classes of lines, first seen first; a process creation where none is known."""
    found = F.array_distinct(F.filter(F.transform(telemetry, line_class), lambda c: c.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("process_creation")))


def expand(names: list[str]) -> list[str]:
    """Vendors once each, in order; `all` is all of them."""
    out: list[str] = []
    for n in names:
        for v in VENDORS if n == "all" else [ALIASES.get(n, n)]:
            if v not in VENDORS:
                raise ValueError(f"no such vendor: {n}")
            out += [] if v in out else [v]
    return out


def vendor_events(spark: SparkSession) -> DataFrame:
    """class, vendor, label, events: a fixed dimension."""
    rows = [(c, v, VENDORS[v], own) for c, lists in EVENTS.items() for v, own in zip(VENDORS, lists, strict=True)]
    return spark.createDataFrame(rows, "class string, vendor string, label string, events array<string>")


def annotate(findings: DataFrame, vendors: list[str], key: list[str]) -> DataFrame:
    """findings with edr: for each vendor wanted, its distinct events of the finding's classes, in order."""
    wanted = expand(vendors)
    order = F.create_map(*(F.lit(x) for i, v in enumerate(wanted) for x in (v, i)))
    each = findings.select(*key, F.posexplode(classes(F.col("telemetry"))).alias("nth__", "class"))
    table = F.broadcast(vendor_events(findings.sparkSession).where(F.col("vendor").isin(wanted)))  # 52 rows
    listed = each.join(table, "class").groupBy(*key, "vendor", "label").agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth__", "events"))), lambda x: x["events"]))).alias("events"))
    row = F.struct(order[F.col("vendor")].alias("i"), F.struct(F.col("label").alias("vendor"), "events").alias("e"))
    lists = listed.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["e"]).alias("edr"))
    return findings.join(lists, key, "left")
