"""The knowledge base: loading, checking, and matching it against lines and events."""

from __future__ import annotations

import json
from dataclasses import dataclass
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import PRODUCT
from ..functions import sql
from ..functions.shell import COMMAND
from .matcher import Entry

BATCH = 200  # entries in one projection
TECHNIQUES = "array<struct<id:string,name:string>>"
DETECTIONS = "array<struct<source:string,rule:string,confidence:string,verdict:string>>"


@dataclass
class KnowledgeBase:
    platform: str
    note: str
    entries: list[Entry]

    @property
    def product(self) -> str:
        return PRODUCT[self.platform]

    def table(self, spark: SparkSession) -> DataFrame:
        """One row an entry; a dimension of a few hundred rows."""
        rows = [(i, e.id, e.description, e.techniques, e.telemetry, [d | {"verdict": None} for d in e.detections], e.noise) for i, e in enumerate(self.entries)]
        return spark.createDataFrame(rows, f"entry int, rule_id string, description string, techniques {TECHNIQUES}, telemetry array<string>, detections {DETECTIONS}, noise int")


def parse(document: dict) -> KnowledgeBase:
    """Check a knowledge base; anything wrong raises, nothing is skipped."""
    if document["platform"] not in PRODUCT:
        raise ValueError(f"no such platform: {document['platform']}")
    entries = [Entry(**e) for e in document["entries"]]
    ids = [e.id for e in entries]
    if len(set(ids)) != len(ids):
        raise ValueError("entry ids repeat")
    return KnowledgeBase(document["platform"], document["note"], entries)


def load(platform: str) -> KnowledgeBase:
    """The packaged knowledge base of a platform."""
    return parse(json.loads(resources.files("covspark").joinpath("data", f"{PRODUCT[platform]}.json").read_text()))


def severity(noise: Column | str) -> Column:
    noise = F.col(noise) if isinstance(noise, str) else noise
    return F.when(noise >= 75, "critical").when(noise >= 50, "high").when(noise >= 25, "medium").otherwise("low")


def match_units(units: DataFrame, kb: KnowledgeBase, from_raw: bool = True) -> DataFrame:
    """units (commands, raw and any other columns) with a row for each entry that matches.

    What the raw line can tell comes first: lines on which no entry's line axis holds and
    no entry's program can stand are dropped before their commands are parsed, which only
    entries about programs, and those who read matched_command, ask for. All entries of a
    batch are one projection; the entry's own columns come by a broadcast join of the
    dimension. An entry matches a unit once. from_raw: commands are those of raw's text,
    as in scripts; a recorded execution's program may have another name there.
    """
    units = units.withColumn("lraw", F.expr("lower(raw)"))
    if from_raw:
        units = units.where(sql.some(dict.fromkeys(e.raw_test for e in kb.entries if e.on_line)))
    low = "named_struct('program', lower(c.program), 'args', transform(c.args, a -> lower(a)))"
    ready = units.selectExpr("*", f"transform(commands, c -> named_struct('c', c, 'l', {low})) AS pairs")
    none = f"cast(NULL as {COMMAND})"
    tests = [
        f"if({e.raw_test}, named_struct('entry', {i}, 'command', {none}), NULL)" if e.raw_only else f"if(({e.on_line}) IS NULL, NULL, named_struct('entry', {i}, 'command', ({e.on_line}).command))"
        for i, e in enumerate(kb.entries)
        if e.on_line
    ]
    found = _explode(ready, tests, ["pairs", "lraw"], kb)
    return found.withColumn("matched_command", F.coalesce("command", F.get("commands", F.lit(0)))).drop("command")


def match_events(events: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """events (class, fields and others) with a row for each entry whose event axis matches."""
    by_name = "map_from_entries(array_distinct(transform(map_entries(fields), f -> named_struct('k', lower(f.key), 'v', f.value))))"
    ready = events.selectExpr("*", f"{by_name} AS lfields")
    tests = [f"if({e.on_event}, named_struct('entry', {i}), NULL)" for i, e in enumerate(kb.entries) if e.on_event]
    return _explode(ready, tests, ["lfields"], kb)


def _explode(ready: DataFrame, tests: list[str], scratch: list[str], kb: KnowledgeBase) -> DataFrame:
    keep = [c for c in ready.columns if c not in scratch]
    parts = [ready.selectExpr(*keep, f"inline(array_compact(array({', '.join(tests[i : i + BATCH])})))") for i in range(0, len(tests), BATCH)]
    if not parts:
        parts = [ready.selectExpr(*keep, "inline(cast(array() as array<struct<entry:int,command:struct<program:string,args:array<string>,raw:string>>>))")]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    table = F.broadcast(kb.table(ready.sparkSession))  # hundreds of rows
    return found.join(table, "entry").withColumn("severity", severity("noise"))


