"""Nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import tidy
from .store import Store, table

CENTRE_SAMPLE = 4096  # vectors that the centre is the mean of, at most
QUERY_BYTES = 1 << 26  # of query vectors that are broadcast and answered in one scan
QUERY_BLOCK = 1 << 16  # queries of a scan, at most
STEP = 2048  # of them that meet a batch of rows at once
ERROR = 3.0  # standard widths of the error bound on an inner product
ROWS, PAIRS = 2048, 1 << 15  # rows estimated and pairs reranked at once


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals, their norms, and their inner products with their codes."""
    residual = (vectors - centre) @ turn.T
    norm = np.sqrt((residual**2).sum(1))
    cosine = np.abs(residual).sum(1) / np.maximum(norm, 1e-300) / np.sqrt(len(centre))
    return np.packbits(residual > 0, axis=1), norm, np.where(norm > 0, cosine, 1.0)


def _clean(vectors: DataFrame, key: str, value: str, dim: int | None) -> tuple[DataFrame, int]:
    """Usable vectors as arrays of doubles: finite, not zero, of the commonest length."""
    v = F.col(value).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    if dim is None:
        first = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = first["d"] if first else 0
    return good.where(F.size("v") == dim), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build(good: DataFrame, dim: int, centre: np.ndarray) -> DataFrame:
    """The index: id, the packed code, two correction scalars, and the vector for reranking."""
    turn = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, norm, cosine = encode(_matrix(batch.column(1), dim), centre, turn)
            raw = pa.array([x.tobytes() for x in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array(norm), pa.array(cosine), batch.column(1)], ["id", "code", "norm", "cosine", "v"])

    return good.mapInArrow(tidy(run), "id long, code binary, norm double, cosine double, v array<double>")


class Nearest:
    """The k nearest found so far of each query: smallest distance, then smallest id, an id once."""

    def __init__(self, queries: int, k: int):
        self.n, self.k = queries, k
        self.q, self.id, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bound = np.full(queries, np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        q, ids, d = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.d, d])
        order = np.lexsort((d, ids, q))
        q, ids, d = q[order], ids[order], d[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, d = q[once], ids[once], d[once]
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q, "left")
        self.q, self.id, self.d = (x[nth < self.k] for x in (q, ids, d))
        full = nth == self.k - 1
        self.bound[q[full]] = d[full]


def search(index: DataFrame, queries: tuple[np.ndarray, np.ndarray], centre: np.ndarray, k: int) -> DataFrame:
    """Each task's k nearest of a block of queries, which is broadcast.

    Distances are estimated from codes and scalars; a vector whose lower bound
    isn't beyond the k-th distance so far is measured on the original.
    """
    dim = len(centre)
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        residual = (vectors - centre) @ rotation(dim).T
        length = np.sqrt((residual**2).sum(1)).astype(np.float32)
        turned = (residual.T / np.sqrt(dim)).astype(np.float32)
        best = Nearest(len(ids), k)

        def measure(r: np.ndarray, q: np.ndarray, own: np.ndarray, v: np.ndarray) -> None:
            for a in range(0, len(r), PAIRS):
                rr, qq = r[a : a + PAIRS], q[a : a + PAIRS]
                best.add(qq, own[rr], np.sqrt(((v[rr] - vectors[qq]) ** 2).sum(1)))

        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                own, v = part.column(0).to_numpy(), _matrix(part.column(4), dim)
                norm, cosine = (part.column(i).to_numpy().astype(np.float32) for i in (2, 3))
                packed = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(part), -1)
                sign = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
                scale = (norm / cosine)[:, None]
                spread = norm * np.sqrt(np.maximum(0, 1 - cosine**2)) / cosine * np.float32(ERROR / np.sqrt(max(1, dim - 1)))
                for a in range(0, len(ids), STEP):
                    some = slice(a, a + STEP)
                    inner = (sign @ turned[:, some]) * scale
                    guess = norm[:, None] ** 2 + length[some] ** 2 - 2 * inner
                    mine = own[:, None] == ids[some]
                    guess[mine] = np.inf
                    lower = guess - 2 * spread[:, None] * length[some] - np.float32(1e-5) * (norm[:, None] ** 2 + length[some] ** 2)
                    fresh = np.flatnonzero(~np.isfinite(best.bound[some]))
                    if len(fresh):
                        m = min(k, len(part))
                        r = np.argpartition(guess[:, fresh], m - 1, axis=0)[:m]
                        q = np.broadcast_to(fresh, r.shape)
                        ok = np.isfinite(guess[r, q])
                        measure(r[ok], q[ok] + a, own, v)
                    r, q = np.nonzero(~(lower > (best.bound[some] ** 2).astype(np.float32) * np.float32(1 + 1e-5)) & ~mine)  # never a query's own row; what overflows is measured
                    measure(r, q + a, own, v)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.id), pa.array(best.d)], ["query_id", "vec_id", "score"])

    return index.mapInArrow(tidy(run), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 10, key: str = "vec_id", value: str = "embedding", dim: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by Euclidean distance, nearest first.

    Rows that is_query names are searched against all rows but their own vec_id's, in
    scans of at most QUERY_BLOCK of them or QUERY_BYTES. The centre is the mean of at most CENTRE_SAMPLE vectors,
    those whose ids hash lowest; every vector is indexed. Ties go to the smaller vec_id; a
    vec_id on several rows counts once, with its nearest vector (as a query, with the first
    in order). Null or zero vectors, those with null or non-finite components, those of
    another length than the commonest (the shorter on ties) and null ids take no part. Ids are
    integers. An empty table gives no rows; other columns play no part.
    """
    spark, store = vectors.sparkSession, Store(vectors.sparkSession, "ann")
    good, dim = _clean(vectors, key, value, dim)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    sample = good.orderBy(F.xxhash64("id"), "id", "v").limit(CENTRE_SAMPLE).toPandas()
    if not len(sample):
        return empty
    centre = np.stack(sample["v"].to_numpy()).mean(0)
    index = store.keep(build(good, dim, centre), "index")
    asked = index.select(F.col("id").alias(key), "id", "v").where(is_query)
    n = asked.count()
    blocks, found = max(1, -(-n // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * dim))))), []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").toPandas()
        if len(block):
            part = search(index, (block["id"].to_numpy(), np.stack(block["v"].to_numpy())), centre, k)
            found.append(store.keep(part, f"found{b}") if blocks > 1 else part)
    if not found:
        return empty
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return every.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
