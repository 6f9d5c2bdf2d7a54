"""Quality by hierarchical empirical Bayes: a text's own evidence, its host's and its path's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import pieces, tidy, utf8, white_words, words
from .store import Store, table

FIT_ROWS = 20_000  # labelled rows that the text classifier is fitted on, at most
SHAPES, BUCKETS = 12, 52  # features of a text's shape, and of its words by a hash of each
FEATURES = SHAPES + BUCKETS
LEAST, MOST = 1.0, 1e4  # bounds on the strength of a prior, in documents


def features(column: pa.Array) -> np.ndarray:
    """Shape and words of each whole text: FEATURES numbers, 0 for a null or empty one."""
    data, at = utf8(column)
    w = words(column, white_words(), fold=True)
    n, size = len(column), np.diff(at)
    full, counts = size > 0, w.counts()

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, size)

    owner = w.owner()
    order = np.lexsort((w.hash, owner))
    h, o = w.hash[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=n)
    run = np.diff(np.concatenate([np.flatnonzero(new), [len(h)]]))
    most = np.zeros(n)
    np.maximum.at(most, o[new], run)
    per = np.maximum(1, counts)
    upper, lower = (data >= 65) & (data < 91), (data >= 97) & (data < 123)
    digit, high = (data >= 48) & (data < 58), data >= 128
    mark = (data > 32) & ~upper & ~lower & ~digit & ~high
    length = np.bincount(owner, w.end - w.begin, n) / per
    x = np.stack([np.log1p(counts), np.log1p(size), length, distinct / per, most / per, share(upper), share(digit), share(high), share(mark), share(data == 10), share(data == 124), share((data == 33) | (data == 36) | (data == 35) | (data == 37) | (data == 38) | (data == 42))], 1)
    bucket = np.bincount(owner * BUCKETS + (w.hash % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.where(full[:, None], np.concatenate([x, np.sqrt(bucket / per[:, None])], 1), 0.0)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: means, scales and weights, the last the constant's."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * len(x) / 100 * np.eye(len(w))
        step = np.linalg.solve(curve, a.T @ (y - p) - ridge * len(x) / 100 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading www.; NULL if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[Ww]{3}\.)?([^/?#:]+)", 1)), F.lit(""))


def path_of(url: Column, depth: int = 1) -> Column:
    """The first so many segments of a URL's path, those that name its last document left out: /a of http://h/a/b.html."""
    whole = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    segments = F.slice(F.split(F.regexp_replace(whole, "[^/]*$", ""), "/"), 2, depth)
    return F.concat(F.lit("/"), F.array_join(F.filter(segments, lambda x: x != ""), "/"))


def evidence(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, out: list[Column]) -> DataFrame:
    """The columns of out, and p, the classifier's probability from the text t alone."""
    source = docs.select(*out, F.col("t"))
    names = [c for c in source.columns if c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                if model is None:
                    p = np.full(len(part), 0.5)
                else:
                    mean, scale, w = model
                    z = np.clip((features(part.column(part.schema.get_field_index("t"))) - mean) / scale, -8, 8) @ w[:-1] + w[-1]
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p)], [*names, "p"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "t")
    return source.mapInArrow(tidy(run), f"{fields}, p double")


def _strength(n: Column, total: Column, squares: Column, prior: Column) -> list[Column]:
    """Sums over groups from which the strength of their prior follows by moments."""
    mean = total / n
    inside = F.greatest(squares / n - mean * mean, F.lit(0.0)) / n
    return [F.count("*").alias("groups"), F.avg((mean - prior) * (mean - prior)).alias("between"), F.avg(inside).alias("inside")]


def _kappa(groups: float, between: float | None, inside: float | None, mean: float) -> float:
    if not groups or between is None:
        return MOST
    spread = between - inside
    return MOST if spread <= 0 else float(np.clip(mean * (1 - mean) / spread - 1, LEAST, MOST))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """key, host, path, doc_evidence, host_posterior, path_posterior, score, kept for every row.

    doc_evidence is a logistic regression on the shape and the words of the whole text,
    fitted on at most FIT_ROWS labelled rows, those whose key hashes lowest (a key labelled
    more than once counts with its mean; of several texts of a key the one that hashes
    lowest counts). Its sums by host and path, over all rows, are grouped with partial
    sums, and each level is shrunk toward the one above:

        host = (sum_host + a * global) / (n_host + a)
        path = (sum_path - own + b * host') / (n_path - 1 + b)

    with a and b from the variance between groups, so a sparse site says little. A row
    is left out of its own path's sum and, in host', of its host's. The odds of score are
    those of the evidence times path's over the global ones; kept is score >= 0.5. Null or
    empty texts have the evidence of an empty text; null hosts and paths are groups of
    their own; with no labels the evidence is 0.5 for all; repeated rows count each; an
    empty table gives no rows.
    """
    store = Store(docs.sparkSession, "quality")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), host.alias("host"), path.alias("path"))
    known = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(quality).alias("y")).orderBy(F.xxhash64("k"), "k").limit(FIT_ROWS)
    chosen = rows.join(F.broadcast(known), "k").select("k", "y", "t", F.xxhash64("t").alias("h"))  # at most FIT_ROWS keys

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                x = features(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64())), part.column(3)], ["k", "y", "x", "h"])

    kind = rows.schema["k"].dataType.simpleString()
    sample = chosen.mapInArrow(tidy(measure), f"k {kind}, y double, x array<double>, h long").toPandas().sort_values(["k", "h"]).drop_duplicates("k")
    model = fit(np.stack(sample["x"].to_numpy()), sample["y"].to_numpy()) if len(sample) else None

    scored = store.keep(evidence(rows, model, [F.col("k"), F.col("host"), F.col("path")]), "scored")
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")]
    paths = store.keep(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = store.keep(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = float(np.clip(total["s"] / total["n"], 1e-6, 1 - 1e-6)) if total["n"] else 0.5
    a = _kappa(*hosts.agg(*_strength(F.col("n"), F.col("s"), F.col("ss"), F.lit(overall))).first(), overall)
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs"), ((F.col("s") + a * overall) / (F.col("n") + a)).alias("host_posterior"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    b = _kappa(*sites.agg(*_strength(F.col("n"), F.col("s"), F.col("ss"), F.col("host_posterior"))).first(), overall)
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "hn", "hs", "host_posterior")
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    others = (F.col("hs") - F.col("p") + a * overall) / (F.col("hn") - 1 + a)
    own = (F.col("s") - F.col("p") + b * others) / (F.col("n") - 1 + b)
    own = F.least(F.greatest(own, F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = p / (1 - p) * (F.col("path_posterior") / (1 - F.col("path_posterior"))) / (overall / (1 - overall))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    return joined.withColumn("path_posterior", own).withColumn("score", odds / (1 + odds)).select(F.col("k").alias(key), "host", "path", F.col("p").alias("doc_evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no address: hosts are their sources, and a source's sections are its languages."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


