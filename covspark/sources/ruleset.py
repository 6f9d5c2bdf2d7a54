"""Directories of rules as a table, cached as Parquet under a fingerprint."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Rule, documents, header, rule_of
from ..operators.verdict import prepare

SCHEMA = "file string, n int, rule_id string, title string, level string, category string, techniques array<string>, document string"
VERSION = 1
MOST_RULES = 100_000  # compiled on the driver; the largest public set has a few thousand


@dataclass
class Index:
    """rules: one row a rule with a technique; by_technique: exploded; logic by id, None where it can't be read."""

    rules: DataFrame
    files_scanned: int
    rules_indexed: int
    logic: dict[str, Rule | None]

    @property
    def by_technique(self) -> DataFrame:
        return self.rules.select(F.explode(F.array_distinct("techniques")).alias("technique"), "rule_id", "title", "level", "category", "file", "n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yml,yaml}").load(path)


def parse(files: DataFrame, product: str) -> DataFrame:
    """SCHEMA from files (path, content); a document that is no rule of the product gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for n, document in enumerate(documents(bytes(content).decode("utf-8", "replace"))):
                    if own := header(document, product):
                        rows.append({"file": path, "n": n, **own, "document": json.dumps(document, default=str)})
            yield pd.DataFrame(rows, columns=["file", "n", "rule_id", "title", "level", "category", "techniques", "document"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def fingerprint(spark: SparkSession, path: str, product: str) -> str:
    """Changes when a rule file comes, goes or changes size or time."""
    stat = _files(spark, path).agg(F.sort_array(F.collect_list(F.struct("path", "length", "modificationTime"))).alias("s"))
    return str(stat.select(F.xxhash64(F.to_json("s"), F.lit(product), F.lit(VERSION))).first()[0])


def load(spark: SparkSession, path: str, product: str, cache: str | None = None) -> Index:
    """The rules under path for a product. cache: a folder for parsed rules, used while their fingerprint holds."""
    prepare(spark)
    parsed = parse(_files(spark, path), product)
    if cache:
        at = f"{cache.rstrip('/')}/{fingerprint(spark, path, product)}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            parsed.write.mode("overwrite").parquet(at)
        parsed = spark.read.schema(SCHEMA).parquet(at)
    return index(parsed, _files(spark, path).count())


def index(parsed: DataFrame, files_scanned: int) -> Index:
    """Only rules with a technique are indexed; their logic is read on the driver."""
    rules = parsed.where(F.size("techniques") > 0)
    found = rules.select("rule_id", "document").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    logic = {r.rule_id: rule_of(json.loads(r.document)) for r in found}
    for rule_id, rule in logic.items():
        if rule:
            rule.id = rule_id
    return Index(rules, files_scanned, len(found), logic)


def from_texts(spark: SparkSession, texts: dict[str, str], product: str) -> Index:
    """An index of rules given as YAML texts by file name."""
    prepare(spark)
    files = spark.createDataFrame([(k, bytearray(v, "utf-8")) for k, v in texts.items()], "path string, content binary")
    return index(parse(files, product), len(texts))
