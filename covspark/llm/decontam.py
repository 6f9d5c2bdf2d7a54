"""Benchmark decontamination with a positional inverted index.

The training texts are cut into segments of bounded size. A segment's postings,
a row for each of its terms with the places at which it stands, are stored; a
segment holds whole texts, and no match spans two. Test phrases are found by
intersecting offset-adjusted lists within each segment, rarest term first, exactly
and by proximity. A term is known by 128 bits of its word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import pieces, plain_words, ranges, signed, tidy, words
from .store import Store, table

WINDOW = 10
SEGMENT_BYTES = 1 << 23  # of text in a segment, about; one text at least
BLOCK_WORDS = 1 << 20  # of test words searched at once, and broadcast
CANDIDATES = 1 << 20  # candidate places examined at once, about
SLACK = 1  # ordinals by which a word of a proximity match may stand off, in the query


def item_words(items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of the words of texts, one text after another, and their n + 1 offsets."""
    w = words(items, plain_words(), fold=True, versions=2)
    return w.hash, w.check, w.at


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """segment, term, check, places: postings of every word of every text.

    places are little-endian int32 ordinals of words in the segment. The row without
    a term holds instead each text's first ordinal (and the end), keys has
    the texts' keys in that order. Null and empty texts are there with no words.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def segment(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        keys, column = whole.column(0).combine_chunks(), whole.column(1).combine_chunks()
        term, check, at = item_words(column)
        order = np.argsort(term, kind="stable").astype(np.int32)
        a, b = term[order], check[order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # words that differ in their second hash only
            order = np.lexsort((check, term)).astype(np.int32)
            a, b = term[order], check[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        raw = np.concatenate([at.astype("<i4"), order.astype("<i4")])
        edges = np.concatenate([[0], len(at) + new, [len(raw)]]) * 4 if len(a) else np.array([0, len(raw) * 4])
        n = len(edges) - 1
        places = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)])
        terms, checks = (pa.array(np.concatenate([[0], signed(x[new])]).astype(np.int64), mask=np.arange(n) == 0) for x in (a, b))
        own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(n, len(keys))]).astype(np.int32)), keys)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, uuid.uuid4().int & ((1 << 62) - 1))), terms, checks, places, own], ["segment", "term", "check", "places", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in pieces(batch, "t", SEGMENT_BYTES):
                if held and size + part.nbytes > 1.25 * SEGMENT_BYTES:
                    yield segment(held)
                    held, size = [], 0
                held.append(part)
                size += part.nbytes
        if held:
            yield segment(held)

    return source.mapInArrow(tidy(run), f"segment long, term long, check long, places binary, keys array<{kind}>")


class Tests:
    """Distinct windows of a block of test items: rows of term numbers, padded, and the items that have each."""

    def __init__(self, ids: list[str], term: np.ndarray, check: np.ndarray, at: np.ndarray, window: int):
        self.ids = ids
        self.terms, number = np.unique(np.stack([term, check], 1), axis=0, return_inverse=True)
        number = number.ravel()
        counts = np.diff(at)
        length = np.minimum(counts, window)
        begin = np.concatenate([ranges(at[:-1], np.maximum(counts - window + 1, 0)), at[:-1][(counts > 0) & (counts < window)]])
        owner = np.searchsorted(at, begin, "right") - 1
        size = length[owner]
        offset = np.arange(window)
        words_of = np.where(offset < size[:, None], number[np.minimum(begin[:, None] + offset, max(0, len(number) - 1))] if len(number) else 0, 0)
        rows, self.row = np.unique(np.concatenate([words_of, size[:, None]], 1), axis=0, return_inverse=True)
        self.row, self.owner = self.row.ravel(), owner
        self.words, self.size = rows[:, :-1], rows[:, -1]


def phrases(tests: Tests, terms: np.ndarray, lists: list[np.ndarray], bounds: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches (window row, first ordinal, text) of all test windows in a segment, whose texts begin at bounds.

    terms are the numbers of the segment's test terms, in order. A window's candidates
    are the places of its rarest term there, less the term's offset; the other terms'
    lists cut them down, by rising length. All words stand in one text. With slack
    there is a match at p if every word j of the window stands at some place from
    p + j - slack to p + j + slack, whichever the segment's rarest term is.
    """
    n, total = len(terms), int(bounds[-1])
    none = (np.zeros(0, np.int64),) * 3
    if not n or not len(tests.words):
        return none
    there = np.minimum(np.searchsorted(terms, tests.words), n - 1)
    used = np.arange(tests.words.shape[1]) < tests.size[:, None]
    sizes = np.array([len(x) for x in lists], np.int64)
    alive = np.flatnonzero(((terms[there] == tests.words) | ~used).all(1) & (tests.size > 0))
    if not len(alive):
        return none
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(lists).astype(np.int64)
    term_at = np.zeros(total, np.int32)  # the term of each ordinal, or 0: lists inverted for the intersection
    term_at[flat] = np.repeat(np.arange(1, n + 1), sizes)
    order = np.argsort(np.where(used[alive], sizes[there[alive]], np.iinfo(np.int64).max), axis=1, kind="stable")
    rarest = there[alive, order[:, 0]]
    upto = np.cumsum(sizes[rarest])
    found = []
    a = 0
    while a < len(alive):  # so many windows at once that their candidates are bounded
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CANDIDATES, "right")))
        row, own = alive[a:b], rarest[a:b]
        place = flat[ranges(at[own], sizes[own])]
        text = np.searchsorted(bounds, place, "right") - 1
        nth = np.repeat(np.arange(a, b), sizes[own])
        for shift in range(-slack, slack + 1):
            start, doc, nth_ = place - order[nth, 0] + shift, text, nth
            for j in range(1, tests.words.shape[1]):
                row = alive[nth_]
                o = order[nth_, j]
                ok = j >= tests.size[row]
                want, low, high = there[row, o] + 1, bounds[doc], bounds[doc + 1]
                for off in range(-slack, slack + 1):
                    spot = start + o + off
                    inside = (spot >= low) & (spot < high)
                    ok |= inside & (term_at[np.where(inside, spot, 0)] == want)
                start, doc, nth_ = start[ok], doc[ok], nth_[ok]
            found.append((alive[nth_], start, doc))
        a = b
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def covered(n: np.ndarray, hit: pa.Array) -> np.ndarray:
    """Of texts of so many words each, how many words their spans (begin, size) cover."""
    at = np.asarray(hit.offsets).astype(np.int64)
    begin, size = (np.asarray(hit.values.field(i))[at[0] : at[-1]] for i in (0, 1))
    at -= at[0]
    base = np.concatenate([[0], np.cumsum(n + 1)])
    owner = np.repeat(np.arange(len(n)), np.diff(at))
    marks = np.bincount(base[owner] + begin, minlength=int(base[-1]) + 1) - np.bincount(base[owner] + begin + size, minlength=int(base[-1]) + 1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
    return (sums[base[1:]] - sums[base[:-1]]).astype(np.int64)


def _per_text(text: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), values)


def search(index: DataFrame, tests: Tests, slack: int = 0) -> DataFrame:
    """key, n_words, n_hit, hit (first ordinals and lengths within the text), items and near (those with a proximity match), for each text of the index.

    Only postings of test terms leave the index; a segment's meet in one task.
    """
    spark = index.sparkSession
    numbers = signed(tests.terms)
    none = np.arange(len(numbers) + 1) == len(numbers)  # the row without a term
    # as an Arrow table: rows of Python objects would go through workers of another kind, which then stay
    asked = spark.createDataFrame(pa.table({"x": pa.array(np.append(numbers[:, 0], 0), mask=none), "y": pa.array(np.append(numbers[:, 1], 0), mask=none), "number": pa.array(np.where(none, -1, np.arange(len(none))).astype(np.int32))}))
    shared = spark.sparkContext.broadcast(tests)
    kind = index.schema["keys"].dataType.elementType.simpleString()

    def run(whole: pa.Table) -> pa.Table:
        tests = shared.value
        number = whole.column("number").to_numpy()
        order = np.argsort(number)
        places = whole.column("places").combine_chunks()
        bounds, *lists = (np.frombuffer(places[int(i)].as_buffer(), "<i4") for i in order)
        bounds = bounds.astype(np.int64)
        keys = whole.column("keys")[int(order[0])].values
        n = len(keys)
        by_row = np.argsort(tests.row, kind="stable")
        names = np.array(tests.ids, object)

        def items(row: np.ndarray, text: np.ndarray) -> pa.Array:
            once = np.unique(np.stack([text, row], 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
            first, last = (np.searchsorted(tests.row[by_row], once[:, 1], side) for side in ("left", "right"))
            pairs = np.unique(np.stack([np.repeat(once[:, 0], last - first), tests.owner[by_row][ranges(first, last - first)]], 1), axis=0) if len(row) else once
            return _per_text(pairs[:, 0], n, pa.array(names[pairs[:, 1]] if len(pairs) else [], pa.string()))

        row, start, text = phrases(tests, number[order][1:], lists, bounds)
        best = np.unique(np.stack([text, start - bounds[text], tests.size[row]], 1), axis=0) if len(row) else np.zeros((0, 3), np.int64)
        hit = _per_text(best[:, 0], n, pa.StructArray.from_arrays([pa.array(best[:, 1]), pa.array(best[:, 2])], ["begin", "size"]))
        exact = items(row, text)
        if slack:
            row, _, text = phrases(tests, number[order][1:], lists, bounds, slack)
        return pa.table({"segment": pa.array(np.full(n, whole["segment"][0].as_py())), "nth": pa.array(np.arange(n)), "k": keys, "n_words": pa.array(np.diff(bounds)), "n_hit": pa.array(covered(np.diff(bounds), hit)), "hit": hit, "items": exact, "near": items(row, text) if slack else exact})

    kind = f"segment long, nth long, k {kind}, n_words long, n_hit long, hit array<struct<begin:long,size:long>>, items array<string>, near array<string>"
    met = index.join(F.broadcast(asked), F.col("term").eqNullSafe(F.col("x")) & F.col("check").eqNullSafe(F.col("y")))  # at most BLOCK_WORDS terms
    return met.select("segment", "number", "places", "keys").groupBy("segment").applyInArrow(run, kind)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 0, key: str = "doc_id", text: str = "text", item: str = "item_id", store: Store | None = None) -> DataFrame:
    """key, n_words, n_hit, items (sorted as strings), spans (begin, size of hit windows), near.

    Words are [0-9a-z and all beyond ASCII]+ after A-Z became a-z. An occurrence is
    that of window consecutive words of an item, or of all of a shorter item's. near
    has, sorted, the items with a proximity match, where each word may stand up to
    slack places off (with no slack, it equals items); it decides nothing else. Test
    items are searched in blocks of about BLOCK_WORDS words, each broadcast, against
    all postings. Null texts have no words; items without words hit nothing; items
    with a null id are named "", items of one id count as one; rows that repeat a key
    stay rows of their own; an empty benchmark hits nothing. Keys may be of any type.
    """
    spark = docs.sparkSession
    store = store or Store(spark, "postings")
    index = store.keep(build_index(docs, key, text), "index")
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    weight = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks, found = max(1, -(-weight // (4 * BLOCK_WORDS))), []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).distinct().toArrow()
        hashes = item_words(block.column("t").combine_chunks()) if len(block) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64))
        part = search(index, Tests(block.column("i").to_pylist(), *hashes, window), slack)
        found.append(store.keep(part, f"found{b}") if blocks > 1 else part)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = covered(batch.column(1).to_numpy(), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *batch.columns[2:]], ["k", "n_words", "n_hit", "hit", "items", "near"])

    out = found[0]
    if len(found) > 1:  # each block returns every text, known by its segment and place there
        for more in found[1:]:
            out = out.unionByName(more)
        out = out.groupBy("segment", "nth", "k", "n_words").agg(F.flatten(F.collect_list("hit")).alias("hit"), *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")))
        kind = out.schema["k"].dataType.simpleString()
        out = out.select("k", "n_words", "hit", "items", "near").mapInArrow(tidy(cover), f"k {kind}, n_words long, n_hit long, hit array<struct<begin:long,size:long>>, items array<string>, near array<string>")
    return out.select(F.col("k").alias(key), "n_words", "n_hit", *(F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near")), F.col("hit").alias("spans"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=SLACK)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))
