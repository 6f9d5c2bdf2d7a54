"""Sharding by sampled splitters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Store, table

SHARDS = 8
ROWS_PER_RANGE = 200_000
MOST_RANGES = 1 << 17  # 2.6e10 rows at ROWS_PER_RANGE; beyond, ranges hold more rows each
SAMPLES_PER_RANGE = 32


def _sample(rows: DataFrame, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of rows drawn with a chance of rate times their size."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(rate))
    draw = F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    got = rows.where(draw < chance).select("key", (F.col("size") / chance).alias("weight")).toPandas().sort_values("key")
    return got["key"].to_numpy(np.int64), got["weight"].to_numpy(float)


def _quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    if not len(keys) or parts < 2:
        return np.zeros(0, np.int64)
    sums = np.cumsum(weights)
    return np.unique(keys[np.minimum(np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts), len(keys) - 1)])


def shard(docs: DataFrame, shards: int = SHARDS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Deal docs into shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A range is one window task, of about rows_per_range rows; there are MOST_RANGES at most.

    The order is by a key of 40 bits of the text's hash and 24 of doc_id's, so
    equal texts lie side by side and even a group with most rows can be split.
    Size-weighted samples of the key (at most SAMPLES_PER_RANGE * MOST_RANGES rows)
    give the splitters of ranges; ranges over twice the mean are sampled again and
    subdivided. Running sums within ranges, over sums of the ranges before, give
    each row its place in all bytes: its shard is where its middle byte falls.
    So shards differ by less than one text. Texts themselves aren't moved.

    Null text has size 1 and the crc32 of no bytes; an empty table gives no rows;
    rows alike in every way get places of their own.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    high, low = F.lit(-(1 << 24)), F.lit((1 << 24) - 1)
    rows = store.keep(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).bitwiseAND(high).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(low)).alias("key")), "keys")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = int(min(MOST_RANGES, max(4 * shards, n // rows_per_range)))
    splitters = _quantiles(*_sample(rows, SAMPLES_PER_RANGE * parts / max(total, 1), 0), parts)
    for seed in range(1, 4):
        ranged = _in_ranges(rows, splitters)
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("range")
        over = sums[(sums["bytes"] > 2 * total / parts) & (sums["rows"] > 1)] if n else sums
        if not len(over) or len(sums) > 2 * MOST_RANGES:
            break
        found = [splitters]
        keys, weights = _sample(ranged.where(F.col("range").isin(over["range"].tolist())), SAMPLES_PER_RANGE * parts / max(total, 1) * 4, seed)
        owner = np.searchsorted(splitters, keys, "right")
        for r, b in zip(over["range"], over["bytes"], strict=True):
            found.append(_quantiles(keys[owner == r], weights[owner == r], int(np.ceil(b * parts / total))))
        more = np.unique(np.concatenate(found))
        if len(more) == len(splitters):
            break
        splitters = more
    else:
        ranged = _in_ranges(rows, splitters)
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("range")
    base = pd.DataFrame({"range": sums["range"].astype("int32"), "bytes_before": (sums["bytes"].cumsum() - sums["bytes"]).astype("int64"), "rows_before": (sums["rows"].cumsum() - sums["rows"]).astype("int64")})
    before = spark.createDataFrame(base, "range int, bytes_before long, rows_before long")  # at most a few times MOST_RANGES rows
    order = W.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32")
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        ranged.withColumns({"upto": F.sum("size").over(run), "nth": F.row_number().over(order)})
        .join(F.broadcast(before), "range")
        .select("doc_id", "size", "text_crc32", F.expr(f"int(least({shards - 1}, ({shards} * (2 * (bytes_before + upto) - size)) div {2 * max(total, 1)}))").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place"))
    )
    placed = store.keep(placed, "placed")
    store.drop("keys")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _in_ranges(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(), "right").astype(np.int32))

    return rows.withColumn("range", place("key"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
