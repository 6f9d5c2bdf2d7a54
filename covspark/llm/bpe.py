"""Byte-level BPE: a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary, which resolves each
pre-token that is itself a token. Tier two merges the rest with a heap over
linked bytes; a table of bounded bytes remembers what was merged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import mix, pieces, ranges, tidy, utf8
from .store import table

PIECE = 1 << 20  # bytes of text handled at once, a text at least
LONG = 1 << 20  # characters beyond which a text is split a part at a time
STEP = 1 << 18  # pre-tokens of such a part
MEMO = 64 << 20  # bytes, about, of merged pre-tokens that a worker remembers
ENTRY = 200  # bytes of one, about, besides its text and ids


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash: n keys to slots 0 to n - 1, with the key kept per slot.

    Keys fall into buckets; a displacement for each bucket, found largest bucket
    first, sends its keys to free slots. A bucket of one key names its slot.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        bucket, own = self._split(keys)
        self.shift = np.zeros(self.buckets, np.int64)
        free, slot_of = np.ones(n, bool), np.zeros(len(keys), np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        lone = []
        for b in np.argsort(-sizes, kind="stable"):
            members = order[edges[b] : edges[b + 1]]
            if len(members) == 1:
                lone.append((b, members[0]))
                continue
            if not len(members):
                break
            d0 = 0
            while True:
                at = self._place(own[members], np.arange(d0, d0 + 512)[:, None])
                ok = free[at].all(1)
                for r in np.flatnonzero(ok):
                    if len(set(at[r].tolist())) == len(members):
                        break
                else:
                    d0 += 512
                    continue
                self.shift[b], slot_of[members] = d0 + r, at[r]
                free[at[r]] = False
                break
        for (b, key), slot in zip(lone, np.flatnonzero(free), strict=False):
            self.shift[b], slot_of[key] = -1 - slot, slot
        self.keys: list[bytes] = [b""] * n
        for key, slot in zip(keys, slot_of.tolist(), strict=True):
            self.keys[slot] = key

    def _split(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
        return (raw[:, 0] % np.uint64(self.buckets)).astype(np.int64), raw[:, 1]

    def _place(self, own: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(own + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> list[int]:
        """Each key's slot, or -1 where it isn't among those the hash was made for."""
        if not keys:
            return []
        bucket, own = self._split(keys)
        shift = self.shift[bucket]
        at = np.where(shift < 0, -1 - shift, self._place(own, shift)).tolist()
        return [s if self.keys[s] == key else -1 for s, key in zip(at, keys, strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of lowest rank, leftmost first, joins until none can.

    A heap holds pairs over a linked list of parts: n log n for a piece of n bytes.
    An entry is one number: a pair's rank, where it begins and where it ends.
    """
    n, find = len(piece), ranks.get
    w = (n + 1).bit_length()
    low, wide = (1 << w) - 1, 2 * w
    end, before = list(range(1, n + 2)), list(range(-1, n))  # a part that was taken in has end 0
    heap = []
    for i in range(n - 1):
        r = find(piece[i : i + 2])
        if r is not None:
            heap.append(r << wide | i << w | i + 2)
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i, stop = entry >> w & low, entry & low
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[j], end[i], before[stop] = 0, stop, i
        if stop < n:
            far = end[stop]
            r = find(piece[i:far])
            if r is not None:
                heapq.heappush(heap, r << wide | i << w | far)
        h = before[i]
        if h >= 0:
            r = find(piece[h:stop])
            if r is not None:
                heapq.heappush(heap, r << wide | h << w | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Ranks and their perfect hash: made once, on the driver, and broadcast. Its size is the vocabulary's."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.hash = ranks, PerfectHash(list(ranks))
        self.id_at = np.array([ranks[k] for k in self.hash.keys] if ranks else [0], np.int32)

    def names(self) -> list[bytes | None]:
        """The bytes of each id."""
        out: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for b, i in self.ranks.items():
            out[i] = b
        return out


class Encoder:
    """Ids of texts. State is the vocabulary and a table of merged pre-tokens, bounded by its bytes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, memo: int = MEMO):
        self.of, self.pattern, self.most = vocabulary, regex.compile(pattern), memo
        self.memo: dict[bytes, bytes] = {}
        self.past: dict[bytes, bytes] = {}  # what was remembered before, the older half
        self.held = 0

    def merged(self, piece: bytes) -> bytes:
        """The ids of a pre-token, as int32."""
        ids = self.memo.get(piece)
        if ids is None:
            ids = self.past.get(piece) or np.array(merge(piece, self.of.ranks), np.int32).tobytes()
            size = ENTRY + len(piece) + len(ids)
            if self.held + size > self.most // 2:
                self.past, self.memo, self.held = self.memo, {}, 0
            if size <= self.most // 2:
                self.memo[piece] = ids
                self.held += size
        return ids

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and how many each has. The perfect hash answers for each distinct word once."""
        code = {x: i for i, x in enumerate(set(words))}
        raw = [x.encode("utf-8", "surrogatepass") for x in code]
        slot = np.array(self.of.hash.slots(raw), np.int64)
        each = [self.merged(raw[i]) for i in np.flatnonzero(slot < 0)]
        count = np.ones(len(raw), np.int64)
        count[slot < 0] = [len(x) // 4 for x in each]
        first = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        flat[first[slot >= 0]] = self.of.id_at[slot[slot >= 0]]
        if each:
            flat[ranges(first[slot < 0], count[slot < 0])] = np.frombuffer(b"".join(each), np.int32)
        codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
        return flat[ranges(first[codes], count[codes])], count[codes]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and their n + 1 offsets; null is empty.

        Pre-tokens of a long text exist a part at a time.
        """
        out, sizes, words, owner = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), [], []

        def flush() -> None:
            if words:
                ids, count = self.lookup(words)
                out.append(ids)
                np.add.at(sizes, np.repeat([i for i, _ in owner], [n for _, n in owner]), count)
            words.clear()
            owner.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) <= LONG:
                found = self.pattern.findall(text)
                words += found
                owner.append((i, len(found)))
                if len(words) >= STEP:
                    flush()
                continue
            matches = self.pattern.finditer(text)
            while found := [m.group() for m in islice(matches, STEP)]:
                words += found
                owner.append((i, len(found)))
                flush()
        flush()
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


class Decoder:
    """What ids stand for, by one gather."""

    def __init__(self, vocabulary: Vocabulary):
        names = vocabulary.names()
        self.names = pa.array(names, pa.large_binary())
        self.numbers = pa.array([f"{i} " for i in range(len(names))], pa.large_string())

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the offsets in them that at, offsets of ids, come to."""
        data, ends = utf8(self.names.take(pa.array(ids)))
        return data, ends[at]

    def digests(self, ids: np.ndarray, at: np.ndarray) -> tuple[list[str], list[str]]:
        """Of each text: SHA-256 of its ids in decimal, joined by a space, and of its decoded bytes."""
        plain, ends = utf8(self.numbers.take(pa.array(ids)))
        data, edge = self.decode(ids, at)
        ends = ends[at]
        said = [hashlib.sha256(plain[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return said, [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _list_column(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: str = "doc_id", out: str = "token_ids") -> DataFrame:
    """key and its text's ids. The vocabulary is broadcast.

    Null and empty texts have no ids. Rows stay as they are, repeated ones too;
    other columns of docs play no part, whatever their names. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField("k", source.schema["k"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for part in pieces(batch, "t", PIECE):
                ids, at = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), _list_column(ids, at)], ["k", "ids"])

    return source.mapInArrow(tidy(run), schema).select(F.col("k").alias(key), F.col("ids").alias(out))


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", key: str = "doc_id", out: str = "decoded") -> DataFrame:
    """key, the ids, and the bytes that they stand for; null ids are none. An id that the vocabulary lacks raises."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    source = tokens.select(F.col(key).alias("k"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    schema = T.StructType([*source.schema.fields, T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            column = batch.column(1)
            at = np.asarray(column.offsets).astype(np.int64)
            step = max(1, (1 << 20) * len(batch) // max(1, int(at[-1] - at[0])))
            for a in range(0, len(batch), step):
                b = min(len(batch), a + step)
                data, ends = decoder.decode(np.asarray(column.values.slice(at[a], at[b] - at[a])), at[a : b + 1] - at[a])
                texts = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column.slice(a, b - a), texts], ["k", "ids", "b"])

    return source.mapInArrow(tidy(run), schema).select(F.col("k").alias(key), F.col("ids").alias(ids), F.col("b").alias(out))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: digests of what a text encodes to and of what that decodes to; and token_ids, if asked for.

    One pass over the rows, so a task has one Python worker. Null, empty, repeated
    and clashing rows are as in encode.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = f"k {source.schema['k'].dataType.simpleString()}, {'token_ids array<int>, ' if ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value, pattern), Decoder(shared.value)
        for batch in batches:
            for part in pieces(batch, "t", PIECE):
                own, at = encoder.encode(part.column(1).to_pylist())
                columns = {"k": part.column(0)} | ({"token_ids": _list_column(own, at)} if ids else {})
                said, back = decoder.digests(own, at)
                yield pa.RecordBatch.from_pydict(columns | {"n_tokens": pa.array(np.diff(at)), "ids_sha256": pa.array(said, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return source.mapInArrow(tidy(run), kind).withColumnRenamed("k", key)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
