"""Near-duplicates by MinHash with tensored banding; every link is confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import mix, pieces, signed, starts, tidy, utf8, white_words, windows, words
from .store import BROADCAST_ROWS, Store, narrow, table

WORDS, PERCENT = 5, 75
SIDE, EACH = 10, 2  # half keys on each of two sides, and minhashes in one: SIDE**2 table keys from 2 * SIDE * EACH minhashes
STAR_ROUNDS = 3
PARTNERS = 2  # pivots that a text is first compared with; the others follow where still open
CELLS = 64  # classes of shingles by which intersections are bounded
SALT = 48  # texts compared with one copy of a pivot's set, about: small lots spread evenly


def shingles(column: pa.Array, length: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, one text after another, and n + 1 offsets."""
    w = words(column, white_words(), fold=True)
    counts = w.counts()
    sizes = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(at[-1]), np.uint64)
    long = counts >= length
    where = starts(w.at, length)
    spot = np.repeat(at[:-1][long], sizes[long]) + np.arange(len(where)) - np.repeat(np.cumsum(sizes[long]) - sizes[long], sizes[long])
    out[spot] = windows(w.hash, length)[where]
    for n in range(1, length):  # a short text is one shingle, told from longer ones by its length
        own = np.flatnonzero(counts == n)
        if len(own):
            out[at[own]] = mix(windows(w.hash, n)[w.at[own]] + np.uint64(n))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[at]


def sketch(values: np.ndarray, at: np.ndarray, side: int, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each non-empty set: a fingerprint of 128 bits, and 2 * side half keys of each minhashes."""
    first = at[:-1]
    sums = np.add.reduceat(mix(values), first) if len(first) else np.zeros(0, np.uint64)
    other = np.bitwise_xor.reduceat(mix(values ^ np.uint64(0xD1B54A32D192ED03)), first) if len(first) else sums
    seeds = np.random.default_rng(11).integers(0, 1 << 63, (2 * side * each, 2), dtype=np.uint64)
    halves = np.zeros((len(first), 2 * side), np.uint64)
    for j, (seed, odd) in enumerate(seeds):
        if len(first):
            low = np.minimum.reduceat((values ^ seed) * (odd | np.uint64(1)), first)
            halves[:, j // each] = mix(halves[:, j // each] + low + np.uint64(j))
    return sums, other, halves


class _Linker:
    SIFTS = 4

    def __init__(self, texts: DataFrame, store: Store, percent: int):
        self.texts, self.store, self.percent, self.turn = texts, store, percent, 0

    def fits(self, a: str, b: str) -> F.Column:
        """Whether sets of these sizes can reach the similarity at all."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def load(self, ids: DataFrame) -> None:
        """Write the full sets of the classes in ids (id, and a, b: 128 bits of a text that has it)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "t"):
                    values, at = shingles(part.column(1))
                    raw = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
                    yield pa.RecordBatch.from_arrays([part.column(0), raw], ["id", "set"])

        one = self.texts.join(narrow(ids), ["k", "a", "b"]).select("id", "t").dropDuplicates(["id"])  # rows that repeat
        self.sets = self.store.keep(one.mapInArrow(tidy(run), "id long, set binary"), "sets")

    def hopeful(self, held: DataFrame) -> DataFrame:
        """held with v, the shingles that another text of held has too: no intersection is larger.

        Texts with v too small for any link go, and the keys left with one component;
        v is counted anew among the rest, until little changes. cells counts these
        shingles by CELLS classes of their hash: the sum of the lesser counts of two
        texts bounds their intersection too.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, at = utf8(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), np.diff(at) // 8))), pa.array(values.view(np.int64))], ["id", "shingle"])

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, at = utf8(batch.column(1))
                spot = np.repeat(np.arange(len(batch)), np.diff(at) // 8) * CELLS + (values.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)
                count = np.bincount(spot, minlength=len(batch) * CELLS)
                lost = batch.column(2)
                edge = np.asarray(lost.offsets)
                gone = np.asarray(lost.values)[edge[0] : edge[-1]].view(np.uint64) % np.uint64(CELLS)
                count -= np.bincount(np.repeat(np.arange(len(batch)), np.diff(edge)) * CELLS + gone.astype(np.int64), minlength=len(count))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(count) + 1, CELLS, dtype=np.int32)), pa.array(count.astype(np.int32)))], ["id", "cells"])

        for turn in range(self.SIFTS):
            ids = self.store.keep(held.select("id").distinct(), f"sift{turn}")
            before = ids.count()
            own = self.sets.join(narrow(ids, before), "id", "left_semi").select("id", "set")
            each = own.mapInArrow(tidy(run), "id long, shingle long")
            lone = each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
            lone = self.store.keep(lone.groupBy("id").agg(F.collect_list("shingle").alias("lone")), f"lone{turn}")
            held = held.drop("v", "cells").join(lone.select("id", F.size("lone").alias("u")), "id", "left").withColumn("v", F.col("n") - F.coalesce("u", F.lit(0))).drop("u").where(F.col("v") * 100 >= F.col("n") * self.percent)
            mixed = held.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
            held = self.store.keep(held.join(mixed, "key", "left_semi"), f"held{turn}")
            left = held.select("id").distinct()
            if turn == self.SIFTS - 1 or left.count() > 0.9 * before:
                break
        found = own.join(narrow(left), "id", "left_semi").join(lone, "id", "left").select("id", "set", F.coalesce("lone", F.array().cast("array<long>")).alias("lone"))
        return held.join(found.mapInArrow(tidy(cells), "id long, cells array<int>"), "id")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """pairs (id, pivot) with linked. A task holds one pivot's set and streams its partners'."""
        self.turn += 1
        pairs = self.store.keep(pairs, f"pairs{self.turn}")
        n = pairs.count()
        weight = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / SALT).alias("salts"))
        dealt = pairs.join(narrow(weight, n), "pivot").select("pivot", F.pmod(F.xxhash64("id"), "salts").alias("salt"), "id")
        partner = dealt.join(self.sets, "id") if n > BROADCAST_ROWS else F.broadcast(dealt).join(self.sets, "id")
        heads = dealt.select("pivot", "salt").distinct()
        head = (F.broadcast(heads) if n <= BROADCAST_ROWS else heads).join(self.sets, F.col("pivot") == F.col("id"))
        both = head.select("pivot", "salt", F.lit(0).alias("turn"), "id", "set").unionByName(partner.select("pivot", "salt", F.lit(1).alias("turn"), "id", "set"))
        both = both.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "turn")
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(0, np.uint64)
            for batch in batches:
                ids, pivots, linked = [], [], []
                for pivot, turn, i, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                    own = np.frombuffer(raw.as_buffer(), np.uint64)
                    if not turn:
                        held = own
                        continue
                    spot = np.minimum(np.searchsorted(held, own), len(held) - 1)
                    common = int((held[spot] == own).sum())
                    ids.append(i)
                    pivots.append(pivot)
                    linked.append(100 * common >= percent * (len(held) + len(own) - common))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pivots, pa.int64()), pa.array(linked, pa.bool_())], ["id", "pivot", "linked"])

        return self.store.keep(both.mapInArrow(tidy(run), "id long, pivot long, linked boolean"), f"verified{self.turn}")


def components(links: DataFrame, store: Store, name: str) -> DataFrame:
    """id, label (the smallest id reachable) of every id in links (id, pivot): rounds of the
    least label among neighbours, then of the label's own label, until nothing changes."""
    edges = store.keep(links.select(F.col("id").alias("u"), F.col("pivot").alias("v")).union(links.select("pivot", "id")).distinct(), f"{name}-edges")
    labels = store.keep(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        around = edges.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(around, F.col("id") == F.col("u")).select("id", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        lower = store.keep(lower, f"{name}-low")
        up = lower.select(F.col("id").alias("x"), F.col("label").alias("y"))
        new = store.keep(lower.join(up, F.col("label") == F.col("x")).select("id", F.least("label", "y").alias("label"), "was"), f"{name}-{turn}")
        changed = new.where(F.col("label") != F.col("was")).limit(1).count()
        store.drop(f"{name}-{turn - 1}")
        labels = new.select("id", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT, side: int = SIDE, each: int = EACH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept for every row. Keys may be of any type that has an order.

    Texts of one shingle set are one class. A class gets 2 * side half keys of each
    minhashes; halves that no other class has are dropped, and each pair of the rest,
    one from either side, is a table key. At the threshold a link is missed with a
    chance of 2 * (1 - s**each)**side, 0.0005 as set here.

    Classes that share a table key are candidates. Not all pairs are made: texts
    are compared with pivots first, and components grow from confirmed links; where a
    key still holds more than one component, new pivots follow, and at last every pair
    across components that sizes allow and that has enough shingles which any other
    open text shares (exact bounds: no link is lost). Links are confirmed on full sets
    of shingles, each known by 64 bits; a class by 128 bits of its set.

    Rows that repeat a key are one document, which has the links of all its texts.
    Texts without words have empty sets, are linked with nothing and kept, if no text
    of their key is linked. A null key is linked with nothing: its component is null
    and it is kept. An empty table gives no rows; other columns play no part.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, "neardup")
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                values, at = shingles(part.column(1))
                n = np.diff(at)
                full = np.flatnonzero(n)
                a, b, halves = sketch(values, np.concatenate([at[:-1][full], at[-1:]]), side, each)
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                one[full], two[full] = a, b
                sizes = np.zeros(len(n) + 1, np.int32)
                sizes[full + 1] = 2 * side
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(signed(halves.ravel())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(n), pa.array(signed(one)), pa.array(signed(two)), lists], ["k", "a", "b", "n", "f", "g", "halves"])

    rows = store.keep(source.mapInArrow(tidy(run), f"k {kind}, a long, b long, n long, f long, g long, halves array<long>"), "rows")
    whole = rows.where((F.col("n") > 0) & F.col("k").isNotNull())
    classes = whole.groupBy("f", "g", "n").agg(F.min(F.struct("k", "a", "b")).alias("at"), F.any_value("halves").alias("halves"))
    classes = store.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    half = store.keep(classes.select("id", "n", F.posexplode("halves").alias("pos", "half")), "half")
    shared = half.groupBy("half").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("half")
    live = half.join(shared, "half", "left_semi").groupBy("id", "n").agg(F.collect_list(F.when(F.col("pos") < side, F.col("half"))).alias("left"), F.collect_list(F.when(F.col("pos") >= side, F.col("half"))).alias("right"))
    live = store.keep(live, "live")
    keyed = live.select("id", "n", F.explode("left").alias("x"), "right").select("id", "n", "x", F.explode("right").alias("y")).select("id", "n", F.xxhash64("x", "y").alias("key"))
    keyed = store.keep(keyed, "keyed")
    store.drop("half")
    tables = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    shared = store.keep(keyed.join(tables.select("key", "c"), "key"), "shared")
    store.drop("keyed")
    weights = store.keep(shared.groupBy("id").agg(F.sum("c").alias("w")), "weights")  # a family's centre shares keys with most of it
    members = store.keep(shared.drop("c").join(narrow(weights), "id"), "members")
    store.drop("shared")

    linker = _Linker(source, store, percent)
    linker.load(store.keep(classes.join(narrow(weights.select("id")), "id", "left_semi").select("id", "at.*"), "asked"))
    heads = members.groupBy("key").agg(F.max(F.struct("w", "id", "n")).alias("p")).select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("m"))
    votes = members.join(heads, "key").where((F.col("id") != F.col("pivot")) & linker.fits("n", "m")).groupBy("id", "pivot").agg(F.count("*").alias("votes"))
    nth = F.row_number().over(W.partitionBy("id").orderBy(F.desc("votes"), "pivot"))  # at most side**2 rows an id
    seen = linker.verify(votes.withColumn("nth", nth).where(F.col("nth") <= PARTNERS).select("id", "pivot"))
    for turn in range(1, STAR_ROUNDS + 1):
        labels = components(seen.where("linked"), store, f"label{turn}")
        own = store.keep(members.join(labels, "id", "left").select("key", "id", "n", "w", F.coalesce("label", "id").alias("label")), f"own{turn}")
        most = store.keep(own.groupBy("key", "label").agg(F.max(F.struct("w", "id", "n")).alias("s")).select("key", F.struct("s.w", "s.id", "s.n", "label").alias("s")), f"most{turn}")
        one = most.groupBy("key").agg(F.max("s").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
        mixed = store.keep(most.join(one, "key").where("s.label != a.label").groupBy("key", "a").agg(F.max("s").alias("b")), f"mixed{turn}")
        store.drop(f"most{turn}")
        if not mixed.limit(1).count():
            break
        if turn < STAR_ROUNDS:
            pivots = own.join(mixed, "key").select("id", "n", "label", F.explode(F.array("a", "b")).alias("p"))
            pivots = pivots.where((F.col("label") != F.col("p.label")) & linker.fits("n", "p.n")).groupBy("id", F.col("p.id").alias("pivot")).agg(F.count("*").alias("votes"))
            pairs = pivots.withColumn("nth", nth).where(F.col("nth") <= PARTNERS * (turn + 1)).select("id", "pivot")
        else:
            held = linker.hopeful(own.drop("w").join(mixed.select("key"), "key", "left_semi")).join(live.select("id", "left", "right"), "id")
            other = held.select("key", F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("v").alias("w"), F.col("cells").alias("theirs"), F.col("label").alias("its"), F.col("left").alias("lefts"), F.col("right").alias("rights"))
            # of the keys that a pair shares one makes it: that of the least halves on either side
            own_key = F.xxhash64(F.array_min(F.array_intersect("left", "lefts")), F.array_min(F.array_intersect("right", "rights")))
            both = F.aggregate(F.zip_with("cells", "theirs", lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
            enough = [x * (100 + percent) >= (F.col("n") + F.col("m")) * percent for x in (F.least("v", "w"), both)]
            pairs = held.join(other, "key").where((F.col("label") < F.col("its")) & linker.fits("n", "m") & enough[0] & enough[1] & (F.col("key") == own_key)).select("id", "pivot")
        ordered = [F.least("id", "pivot").alias("pivot"), F.greatest("id", "pivot").alias("id")]
        fresh = store.keep(pairs.select(*ordered).distinct().join(seen.select(*ordered), ["id", "pivot"], "left_anti"), f"fresh{turn}")
        if fresh.limit(1).count():
            seen = store.keep(seen.unionByName(linker.verify(fresh)), f"seen{turn}")
        store.drop(f"own{turn}")
    links = seen.where("linked").select("id", "pivot")
    own = F.struct("f", "g", "n")
    several = store.keep(rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.min(own).alias("x"), F.max(own).alias("y")).where("x < y").select("k"), "several")
    if several.limit(1).count():  # texts of one key are linked by it
        texts = whole.join(several, "k", "left_semi").join(classes.select("f", "g", "n", "id"), ["f", "g", "n"]).select("k", "id").distinct()
        links = links.unionByName(texts.join(texts.groupBy("k").agg(F.min("id").alias("pivot")), "k").where("id != pivot").select("id", "pivot"))
    labels = store.keep(components(links, store, "label"), "labels")
    named = classes.join(labels, "id", "left").select("f", "g", "n", F.coalesce("label", "id").alias("label"), F.col("at.k").alias("least"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    named = store.keep(named.join(least, "label").select("f", "g", "n", "component"), "named")
    out = rows.select("k", "n", "f", "g").join(named, ["f", "g", "n"], "left")
    if several.limit(1).count():  # a text without words has the component of its key's other texts
        other = whole.join(several, "k", "left_semi").join(named, ["f", "g", "n"]).groupBy("k").agg(F.min("component").alias("its"))
        out = out.join(other, "k", "left").withColumn("component", F.coalesce("component", "its"))
    component = F.when(F.col("k").isNotNull(), F.coalesce("component", "k"))
    store.drop("sets", "members")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("k").isNull() | (F.col("k") == component)).alias("kept"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
