"""Substring dedup by recompression.

Words get names, and texts become sequences of names. In each round runs of a name,
of any length, and then pairs of a left and a right name become symbols. Spark
looks at every distinct one of the whole corpus: its name is a hash of what it stands
for, unless another has that too, and it is dropped if it occurs once. Equal
words far enough inside equal texts so become equal symbols everywhere, and a window
that holds a symbol without a second place is out. In the end a symbol that stands
inside a window, with the words around it that decide it, reveals a repeat; windows
there are then verified by the names of all their words.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import joined, mix, pieces, ranges, signed, starts, tidy, trim, white_words, windows, words
from .store import BROADCAST_ROWS, Store, narrow, table

WINDOW = 35
PAIRS = 1  # times that a round names pairs, after runs
SEGMENT_BYTES = 1 << 21  # of text in a segment, whose symbols a task holds at once; one text at least
TURNS = 4  # parts of the segments that a round settles one after another
SEGMENT_BITS = 16  # segments of a partition (128 GB)
BUCKET_KEYS, LEAST_BITS = 1 << 21, 6  # keys of a bucket, which a task judges at once; buckets are two to so many bits at least
TRIM = 8  # groups after which a worker hands memory back
LONG = 128  # bytes of a word from which its lanes are hashed by halves
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_OTHER = np.uint64(0xD1B54A32D192ED03)


def rounds_of(window: int) -> int:
    """So many rounds that the words which decide a symbol, on average, leave it more than half of a window."""
    rounds, margin, size = 0, 0.0, 1.0
    while True:
        margin += size + sum(size / 2 * (4 / 3) ** i for i in range(PAIRS))
        if 2 * margin > 0.45 * window:
            return max(1, rounds)
        rounds, size = rounds + 1, size * (4 / 3) ** PAIRS


def codes_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys of two numbers: a code for each, the distinct keys by code, and how often each occurs."""
    order = np.argsort(x)
    a, b = x[order], y[order]
    if len(x) and ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((y, x))
        a, b = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    code = np.empty(len(x), np.int64)
    code[order] = np.cumsum(new) - 1
    return code, np.stack([a[new], b[new]], 1), np.diff(np.append(np.flatnonzero(new), len(x)))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word data[begin:end], by lanes of 8 bytes: words of one size up to 8 bytes never share one."""
    size = end - begin
    padded = np.append(data, np.zeros(8, np.uint8))
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # that from each byte on
    out = []
    own = lanes[begin] & _MASKS[np.minimum(size, 8)]
    for seed in (np.uint64(1), _OTHER):
        out.append(mix(mix(size.astype(np.uint64) + seed) + own))
    far, k = np.flatnonzero((size > 8) & (size < LONG)), 8
    while len(far):
        own = lanes[begin[far] + k] & _MASKS[np.minimum(size[far] - k, 8)]
        for h in out:
            h[far] = joined(h[far], own)
        k += 8
        far = far[size[far] > k]
    far = np.flatnonzero(size >= LONG)
    if len(far):
        count = -(-size[far] // 8)
        k = ranges(np.zeros(len(far), np.int64), count) * 8
        own = lanes[np.repeat(begin[far], count) + k] & _MASKS[np.minimum(np.repeat(size[far], count) - k, 8)]
        at = np.concatenate([[0], np.cumsum(count)])
        for h, seed in zip(out, (np.uint64(1), _OTHER), strict=True):
            h[far] = joined(size[far].astype(np.uint64), spans(mix(own + seed), at[:-1], at[1:]))
    return out[0], out[1]


def _planes(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 as rows of their lower, higher ... bytes: compressible each by itself."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _whole(planes: np.ndarray) -> np.ndarray:
    """What _planes was made of."""
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


@dataclass
class Part:
    """Spans of texts of a segment that windows not yet ruled out cover, and their symbols.

    Word m of the spans has the name table[own[m]]; spans begin at words at[:-1]; symbol k,
    with the name table[name[k]], is
    size[k] words from begin[k] (a span's ends may be outside all symbols). For a window
    that begins at word p the symbols from left[p] on, and for one that ends with word q
    those up to right[q], are the same wherever the window stands; gone[p] tells that
    the window at p has no second place. A name of 0 is that of a symbol with one place.
    """

    one: np.ndarray  # texts by 128 bits
    two: np.ndarray
    text: np.ndarray  # of each span
    first: np.ndarray  # the span's first word in its text
    at: np.ndarray
    table: np.ndarray  # names, in no round but the first without those of the words
    own: np.ndarray
    name: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    left: np.ndarray
    right: np.ndarray
    gone: np.ndarray
    code: np.ndarray  # of each symbol among the keys that await names, -1 if it has its name

    @property
    def word(self) -> np.ndarray:
        return self.table[self.own]

    def edges(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that begin at left and that end at right of each word, -1 for none, where these move to the span's far end."""
        begins, ends = np.full((2, len(self.own) + 1), -1)
        begins[self.begin] = ends[self.begin + self.size] = np.arange(len(self.begin))
        first, last = np.where(self.left < high, begins[self.left], -1), np.where(self.right > low, ends[self.right], -1)
        self.left, self.right = np.where(first < 0, high, self.left), np.where(last < 0, low, self.right)
        return first, last

    def parse(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A round over symbols whose names are x and y together: runs, then pairs. The keys of all symbols after it."""
        void, fresh = (self.table == 0)[self.name], np.zeros(len(x), bool)
        low, high = (np.repeat(e, np.diff(self.at)) for e in (self.at[:-1], self.at[1:]))
        for turn in range(PAIRS + 1):
            n = len(x)
            if not n:
                break
            end = self.begin + self.size
            joint = np.zeros(n, bool)  # whether the symbol directly follows the one before, in its span
            joint[1:] = (self.begin[1:] == end[:-1]) & (low[self.begin[1:]] == low[self.begin[:-1]])
            first, last = self.edges(low, high)
            if turn == 0:
                more = joint & ~void
                more[1:] &= (x[1:] == x[:-1]) & (y[1:] == y[:-1])
                head = np.flatnonzero(~more)
                count = np.diff(np.append(head, n))
                to_end = end[np.append(head[1:], n) - 1]  # where each run ends
                run = np.cumsum(~more) - 1
                self.left = np.where(first >= 0, to_end[run[first]], self.left)
                self.right = np.where(last >= 0, self.begin[head[run[last]]], self.right)
                long = count > 1
            else:
                side = mix(x + np.uint64(turn)) >> np.uint64(63) == 1
                is_left, is_right = side & ~void, ~side & ~void
                self.left = np.where((first >= 0) & is_right[first], end[first], self.left)
                self.right = np.where((last >= 0) & is_left[last], self.begin[last], self.right)
                pair = np.zeros(n, bool)
                pair[:-1] = is_left[:-1] & is_right[1:] & joint[1:]
                head = np.flatnonzero(~np.concatenate([[False], pair[:-1]]))
                count = np.diff(np.append(head, n))
                long = count > 1
            tail = np.append(head[1:], n) - 1
            keys = []
            for z in (x, y):
                other = count.astype(np.uint64) if turn == 0 else z[tail]
                keys.append(np.where(long, joined(joined(z[head], np.uint64(turn + 1)), other), z[head]))
            x, y = keys
            self.size, self.begin, void = end[tail] - self.begin[head], self.begin[head], void[head]
            self.name, self.code = self.name[head], self.code[head]
            fresh = fresh[head] | long
        self.code[fresh] = 0
        return x, y

    def settle(self, names: np.ndarray, window: int) -> None:
        """Give awaited names (0: none), rule windows out, and leave what the others cover."""
        self.name = np.where(self.code >= 0, self.code + len(self.table), self.name)
        self.table = np.concatenate([self.table, names])
        none = self.table == 0
        lone = np.concatenate([[0], np.cumsum(none[self.own])])
        void = np.zeros(len(self.own) + 1, np.int64)
        void[self.begin[none[self.name]] + 1] = 1
        void = np.cumsum(void)
        place = starts(self.at, window)
        low, high = self.left[place], np.maximum(self.left[place], self.right[place + window - 1])
        self.gone[place] |= (lone[place + window] > lone[place]) | (void[high] > void[low])
        place = place[~self.gone[place]]
        marks = np.bincount(place, minlength=len(self.own) + 1) - np.bincount(place + window, minlength=len(self.own) + 1)
        live = np.cumsum(marks)[:-1] > 0
        new = live.copy()
        new[1:] &= ~live[:-1]
        new[self.at[:-1]] = live[self.at[:-1]]  # texts stay apart
        begin = np.flatnonzero(new)
        where = np.concatenate([[0], np.cumsum(live)])
        old = np.searchsorted(self.at, begin, "right") - 1
        span = np.cumsum(new) - 1
        end = self.begin + self.size
        inside = live[self.begin] & live[end - 1] & (span[self.begin] == span[end - 1]) & (where[end] - where[self.begin] == self.size)
        self.text, self.first = self.text[old], self.first[old] + begin - self.at[old]
        self.at = np.append(where[begin], where[-1])
        low, high = (np.repeat(e, np.diff(self.at)) for e in (self.at[:-1], self.at[1:]))
        self.left = np.clip(where[self.left[live]], low, high)
        self.right = np.clip(where[self.right[live]], low, high)
        self.own, self.gone = self.own[live], self.gone[live]
        self.begin, self.size, self.name, self.code = where[self.begin[inside]], self.size[inside], self.name[inside], np.full(int(inside.sum()), -1)

    def pack(self) -> bytes:
        """The part in few bytes: names as places in a list, positions as steps, all in the narrowest type, compressed."""
        here = np.arange(len(self.own))
        table, word, name = self.table, self.own, self.name
        if len(table):
            name = np.where(self.code >= 0, 0, name)  # those that await theirs
            often = np.bincount(word, minlength=len(table))
            often += np.bincount(name[self.code < 0], minlength=len(table))
            order = np.argsort(-often)[: np.count_nonzero(often)]  # common names have small numbers
            rank = np.zeros(len(table), np.int64)
            rank[order] = np.arange(len(order))
            table, word, name = table[order], rank[word], rank[name]
        code = self.code + 1
        if not len(table):  # the words await names: they are said once
            name, code = name[:0], code[:0]
        flat = [np.packbits(self.gone), word, name, *(np.diff(x, prepend=0) for x in (self.text, self.at, self.begin))]
        flat += [self.first, self.size, code, self.left - here, here + 1 - self.right]
        raw = pickle.dumps([self.one, self.two, table, *map(_planes, flat)], 5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @staticmethod
    def unpack(data: pa.Scalar) -> Part:
        raw = data.as_buffer()
        size = int.from_bytes(raw[:8].to_pybytes(), "little")
        one, two, table, *flat = pickle.loads(pa.decompress(raw[8:], size, "zstd"))
        gone, word, name, text, at, begin, first, size, code, left, right = map(_whole, flat)
        text, at, begin = map(np.cumsum, (text, at, begin))
        here = np.arange(len(word))
        gone = np.unpackbits(gone.astype(np.uint8), count=len(word)).astype(bool)
        name, code = (name, code - 1) if len(table) else (word, word)
        return Part(one, two, text, first, at, table, word, name, begin, size, here + left, here + 1 - right, gone, code)

    def row(self, seg: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        return {"seg": seg, "n": len(keys), "keys": keys[:, 0].tobytes(), "checks": (keys[:, 1] >> np.uint64(32)).astype(np.uint32).tobytes(), "many": np.packbits(counts > 1).tobytes(), "body": self.pack()}


SEQUENCE = "seg long, n long, keys binary, checks binary, many binary, body binary"
_SCHEMA = pa.schema([("seg", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("keys", "checks", "many", "body"))])


def opened(one: np.ndarray, two: np.ndarray, column: pa.Array, window: int) -> tuple[Part, np.ndarray, np.ndarray] | None:
    """Texts that have a window, with keys for their words, whose codes word and code hold yet."""
    w = words(column, white_words(), versions=0)
    counts = w.counts()
    text = np.flatnonzero(counts >= window)
    if not len(text):
        return None
    own = ranges(w.at[:-1][text], counts[text])
    x, y = word_hashes(w.data, w.begin[own], w.end[own])
    n = len(x)
    code, keys, often = codes_of(x, y)
    order = np.argsort(-often)  # common words have small codes
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code, keys, often = rank[code], keys[order], often[order]
    at = np.concatenate([[0], np.cumsum(counts[text])])
    return Part(one, two, text, np.zeros(len(text), np.int64), at, np.zeros(0, np.uint64), code, code.copy(), np.arange(n), np.ones(n, np.int64), np.arange(n), np.arange(n) + 1, np.zeros(n, bool), code.copy()), keys, often


def _next(part: Part) -> tuple[np.ndarray, np.ndarray]:
    """Parse a round; the keys of the symbols that it made, by code, and how often they occur."""
    x, y = part.parse(*(mix(h)[part.name] for h in (part.table, part.table ^ _OTHER)))
    made = np.flatnonzero(part.code == 0)
    part.code[made], keys, often = codes_of(x[made], y[made])
    return keys, often


def _least(symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each range low..high of symbols, the place of the least hash, the first of equals."""
    rank = mix(symbol ^ _OTHER)
    tables = [np.arange(len(symbol))]
    most = int((high - low).max(initial=0)) + 1
    while (1 << len(tables)) <= most:
        t, step = tables[-1], 1 << (len(tables) - 1)
        a, b = t[:-step], t[step:]
        tables.append(np.concatenate([np.where(rank[b] < rank[a], b, a), t[-step:]]))
    level = np.zeros(len(low), np.int64)
    size = high - low + 1
    for k in range(1, len(tables)):
        level[size >= 1 << k] = k
    out = np.empty(len(low), np.int64)
    for k, t in enumerate(tables):
        own = level == k
        a, b = t[low[own]], t[high[own] - (1 << k) + 1]
        out[own] = np.where(rank[b] < rank[a], b, a)
    return out


def spans(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each h[begin:end], none empty: of its length, its first and its last values, as many of each as a power of two."""
    size = end - begin
    out = np.zeros(len(begin), np.uint64)
    level, step = h, 1
    while len(size) and step <= size.max():
        own = np.flatnonzero((size >= step) & (size < 2 * step))
        out[own] = mix(joined(level[begin[own]], level[end[own] - step]) + size[own].astype(np.uint64))
        level, step = joined(level[:-step], level[step:]), 2 * step
    return out


def groups(part: Part, window: int) -> tuple[np.ndarray, ...]:
    """Windows not ruled out, by the symbol that stands for them: first window, number of windows, where
    the symbol begins, a hash of the words which all windows through it have, and two of all words of
    the group's windows. Equal windows have equal symbols at equal offsets; one without a symbol stands for itself."""
    place = starts(part.at, window)
    place = place[~part.gone[place]]
    low, high = (np.repeat(e, np.diff(part.at)) for e in (part.at[:-1], part.at[1:]))
    first, last = part.edges(low, high)
    i, j = first[place], last[place + window - 1]
    whole = np.flatnonzero((i >= 0) & (j >= i))
    chosen = np.full(len(place), -1)
    if len(whole):
        chosen[whole] = _least(part.table[part.name], i[whole], j[whole])
    new = np.ones(len(place), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (place[1:] != place[:-1] + 1) | (chosen[1:] < 0)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(place)))
    start, own = place[head], chosen[head]
    found = own >= 0
    begin = np.where(found, part.begin[own] if len(part.begin) else 0, start)
    end = np.where(found, begin + (part.size[own] if len(part.begin) else 0), start + window)
    since = np.where(found, np.searchsorted(part.left, begin, "right") - 1, start)  # the last word from which the symbol is decided
    until = np.where(found, np.searchsorted(part.right, end, "left") + 1, start + window)
    h, other = (mix(x)[part.own] for x in (part.table, part.table ^ _OTHER))
    context = mix(spans(h, since, until) + ((begin - since) * 2 + found).astype(np.uint64))
    shape = joined((begin - start).astype(np.uint64), count.astype(np.uint64))
    return start, count, begin, context, *(mix(spans(x, start, start + count + window - 1) + shape) for x in (h, other))


_groups = 0  # that this worker has done


def _sweep() -> None:
    """Before each group of a worker: it hands back memory after some of them."""
    global _groups
    pa.set_memory_pool(pa.system_memory_pool())
    _groups += 1
    if _groups % TRIM == 0:
        trim()


def _binary(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of x in values, each of which ends before x[ends]."""
    at = (np.concatenate([[0], ends]) * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])


def _numbers(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What _binary was made of."""
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), (at[1:] - at[0]) // np.dtype(kind).itemsize


def judged(x: np.ndarray, y: np.ndarray, many: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Of all keys of the corpus by segment that share some of their bits: which have one place; names of all, if any
    shares its x with another."""
    order = np.argsort(x)
    a, b = x[order], y[order]
    new = np.ones(len(x) + 1, bool)
    new[1:-1] = a[1:] != a[:-1]
    lone = np.empty(len(x), bool)
    lone[order] = new[:-1] & new[1:]
    lone &= ~many
    differ = np.flatnonzero(~new[1:-1] & (b[1:] != b[:-1]))
    if not len(differ):
        return lone, None
    clash = np.isin(x, a[differ])
    return lone, np.where(clash, joined(joined(x, y.astype(np.uint64)), np.uint64(turn)), x)


def _named(sequence: DataFrame, turn: int, last: bool, window: int, store: Store) -> DataFrame:
    """A round: over every distinct key of the corpus a bucket of keys at a time finds those with one place, whose windows
    go, and those that share their 64 bits with others (96 bits tell them apart), which get names of their own. Then the
    next symbols are parsed, unless this is the last round."""
    if not turn:
        sequence = sequence.withColumn("part", F.expr(f"int(seg % {TURNS})"))  # later a literal of each table, so the others are not read
    total = sequence.agg(F.sum("n")).first()[0] or 0
    bits = max(LEAST_BITS, (total // BUCKET_KEYS).bit_length())  # a key has an entry for each segment it is in, so equal buckets

    def dealt(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys by bucket, and each one's bucket."""
        bucket = (keys >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
        return np.argsort(bucket, kind="stable"), bucket

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, *row in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3)), strict=True):
                x, y, many = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(row, (np.uint64, np.uint32, np.uint8), strict=True))
                many = np.unpackbits(many, count=len(x))
                order, bucket = dealt(x)
                bucket = bucket[order]
                ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(x)) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1].astype(np.int64)), pa.array(np.full(len(ends), seg)), *(_binary(z[order], ends) for z in (x, y, many))], ["bucket", "seg", "x", "y", "many"])

    def judge(rows: pa.Table) -> pa.Table:
        _sweep()
        (x, ends), (y, _), (many, _) = (_numbers(rows.column(c), kind) for c, kind in (("x", np.uint64), ("y", np.uint32), ("many", np.uint8)))
        lone, names = judged(x, y, many.astype(bool), turn)
        given = pa.nulls(len(rows), pa.binary()) if names is None else _binary(names, ends)
        return pa.table({"seg": rows.column("seg"), "bucket": rows.column("bucket"), "lone": _binary(lone.view(np.uint8), ends), "names": given})

    each = sequence.select("seg", "keys", "checks", "many").mapInArrow(tidy(deal), "bucket long, seg long, x binary, y binary, many binary")
    told = store.keep(each.groupBy("bucket").applyInArrow(judge, "seg long, bucket long, lone binary, names binary"), f"told{turn}")
    store.drop()

    def settle(body: pa.Table, told: pa.Table) -> pa.Table:
        _sweep()
        rows = []
        if len(body):  # a segment may have no keys to hear of
            part = Part.unpack(body.column("body")[0])
            keys = np.frombuffer(body.column("keys")[0].as_buffer(), np.uint64)
            order, _ = dealt(keys)
            told = told.sort_by("bucket")
            names = keys[order]
            at = 0
            for lone, given in zip(told.column("lone").to_pylist(), told.column("names").to_pylist(), strict=True):
                own = names[at : at + len(lone)]
                if given is not None:
                    own[:] = np.frombuffer(given, np.uint64)
                own[np.frombuffer(lone, np.uint8).astype(bool)] = 0
                at += len(lone)
            if at != len(keys):
                raise ValueError("a segment has not heard of all its keys")
            back = np.empty_like(names)
            back[order] = names
            part.settle(back, window)
            if len(part.own):
                keys, often = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
                if not last:
                    keys, often = _next(part)
                rows.append(part.row(body.column("seg")[0].as_py(), keys, often))
        return pa.Table.from_pylist(rows, _SCHEMA)

    done = []  # some of the segments at a time: the shuffle files of the others are not on disk meanwhile
    for n in range(TURNS):
        bodies, names = sequence.where(F.col("part") == n), told.where(F.col("seg") % TURNS == n)
        settled = bodies.select("seg", "keys", "body").groupBy("seg").cogroup(names.groupBy("seg")).applyInArrow(settle, SEQUENCE)
        done.append(store.keep(settled, f"round{turn + 1}-{n}").withColumn("part", F.lit(n)))
        store.drop(f"round{turn}-{n}")
    store.drop(f"round{turn}", f"told{turn}")
    return functools.reduce(DataFrame.unionByName, done)


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """key, text, n_words, n_removed, kept (the words left, joined by one space) for every row;
    with carry, a struct of all of docs' columns, row, too.

    A word goes if a window of so many consecutive words of its text covers it whose word
    sequence also starts at any other place, in the same text or another; windows are
    judged on the input. Words are runs of other characters than space and \\t to \\r.

    Copies of a text lose all words if it has a window; one of them stands for all
    beside other texts. Texts are known by 128 bits, words by names that Spark has
    found to be theirs alone, windows by 128 bits of their words' names. Null texts have no words and stay
    null in text; kept is empty for them. Rows that repeat in every column repeat in the
    result. A segment holds whole texts, so a text takes memory in proportion.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    spark, store = docs.sparkSession, Store(docs.sparkSession, "substrings")
    masks_of = [f"mask{b}" for b in range(-(-window // 32))]  # a group's windows, 32 to a mask
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), (F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.lit(True)).alias("all"))
    row = F.struct(F.xxhash64("k", "t"), F.xxhash64(F.lit(1), "k", "t"))
    copies = store.keep(source.where(F.col("t").isNotNull()).withColumn("row", row).groupBy("a", "b").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1").select("a", "b", "first"), "copies")
    flagged = source.join(narrow(copies), ["a", "b"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << SEGMENT_BITS
        for batch in batches:
            for part in pieces(batch, "t", SEGMENT_BYTES):
                if made := opened(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2), window):
                    yield pa.RecordBatch.from_pylist([made[0].row(seg, *made[1:])], _SCHEMA)
                    seg += 1

    # 1. recompression, a round at a time
    plain = flagged.where(F.col("t").isNotNull())
    distinct = plain.where("first IS NULL").select("a", "b", "t").unionByName(plain.where(F.col("first") == row).select("a", "b", "t").dropDuplicates(["a", "b"]))
    sequence = store.keep(distinct.mapInArrow(tidy(read), SEQUENCE), "round0")
    rounds = rounds_of(window)
    for turn in range(rounds + 1):  # of words, then of symbols
        sequence = _named(sequence, turn, turn == rounds, window, store)

    # 2. reveal: groups of windows by symbol and context
    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = Part.unpack(body)
                first, count, symbol, context, one, two = groups(part, window)
                span = np.searchsorted(part.at, first, "right") - 1
                text = part.text[span]
                columns = {"context": signed(context), "one": signed(one), "two": signed(two), "a": part.one[text], "b": part.two[text], "first": (first - part.at[span] + part.first[span]).astype(np.int32), "count": count.astype(np.int32), "offset": (symbol - first).astype(np.int32), "seg": np.full(len(first), seg), "place": first.astype(np.int32)}
                yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in columns.items()})

    kinds_of = ["context", "one", "two"]
    found = store.keep(sequence.select("seg", "body").mapInArrow(tidy(reveal), "context long, one long, two long, a long, b long, first int, count int, offset int, seg long, place int"), "found")
    # grouped keys are written before they are joined: only then can Spark split the rows of a common one
    twice = store.keep(found.groupBy("context").agg(F.count("*").alias("c")).where("c > 1").select("context"), "twice")
    shared = store.keep(found.join(twice, "context", "left_semi"), "shared")
    store.drop("found")

    # 3. verify: a group that is alone in its context repeats as a whole; where there are several, their windows are compared
    kinds = store.keep(shared.groupBy(*kinds_of).agg(F.count("*").alias("c"), F.min(F.struct("seg", "place", "count", "offset")).alias("at")), "kinds")
    several = store.keep(kinds.groupBy("context").agg(F.count("*").alias("kinds")).where("kinds > 1").select("context"), "several")
    asked = kinds.join(several, "context", "left_semi").select(*kinds_of, "c", "at.*")
    names = ["context", "offset", "x", "y", "one", "two", "nth", "c"]
    kind = "context long, offset int, x long, y long, one long, two long, nth int, c long"

    def spell(body: pa.Table, asked: pa.Table) -> pa.Table:
        _sweep()
        if not len(body) or not len(asked):
            return pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int64()), strict=True)})
        word = Part.unpack(body.column("body")[0]).word
        place, count, offset, context, one, two, c = (asked.column(x).to_numpy().astype(np.int64) for x in ("place", "count", "offset", "context", "one", "two", "c"))
        again, nth = np.repeat(np.arange(len(place)), count), ranges(np.zeros(len(place), np.int64), count)
        at = ranges(place, count)
        x, y = (signed(windows(mix(h), window)[at]) for h in (word, word ^ _OTHER))
        return pa.table(dict(zip(names, map(pa.array, (context[again], (offset[again] - nth).astype(np.int32), x, y, one[again], two[again], nth.astype(np.int32), c[again])), strict=True)))

    spelt = store.keep(sequence.select("seg", "body").groupBy("seg").cogroup(asked.groupBy("seg")).applyInArrow(spell, kind), "spelt")
    same = ["context", "offset", "x", "y"]
    repeated = store.keep(spelt.groupBy(*same).agg(F.sum("c").alias("c")).where("c > 1").select(*same), "repeated")
    masks = spelt.join(repeated, same, "left_semi").groupBy(*kinds_of).agg(*(F.bit_or(F.expr(f"if(nth div 32 = {b}, shiftleft(1, nth % 32), 0)")).alias(m) for b, m in enumerate(masks_of)))
    alone = kinds.where("c > 1").select(*kinds_of, *(F.lit(-1).alias(m) for m in masks_of))
    masks = store.keep(alone.unionByName(masks.join(alone, kinds_of, "left_anti")), "masks")
    hits = store.keep(shared.join(masks, kinds_of).groupBy("a", "b").agg(F.collect_list(F.struct("first", "count", *masks_of)).alias("hits")), "hits")  # a text's own groups
    store.drop("twice", "several", "repeated", "shared", "kinds", "spelt", "masks", *(f"round{rounds + 1}-{n}" for n in range(TURNS)))

    # 4. remove: words that a repeated window covers
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", 1 << 20):
                w = words(part.column(1), white_words(), versions=0)
                n = w.counts()
                lists = part.column(3)
                if lists.null_count:
                    lists = lists.fill_null([])
                at = np.asarray(lists.offsets)
                first, count, *mask = (np.asarray(lists.values.field(i))[at[0] : at[-1]].astype(np.int64) for i in range(2 + len(masks_of)))
                place = ranges(np.repeat(w.at[:-1], np.diff(at)) + first, count)
                nth = ranges(np.zeros(len(first), np.int64), count)
                place = place[np.stack(mask)[nth >> 5, np.repeat(np.arange(len(first)), count)] >> (nth & 31) & 1 == 1]
                total = int(w.at[-1])
                marks = np.bincount(place, minlength=total + 1) - np.bincount(place + window, minlength=total + 1)[: total + 1]
                gone = np.cumsum(marks[:total]) > 0
                whole = part.column(2).to_numpy(zero_copy_only=False).astype(bool) & (n >= window)
                gone |= np.repeat(whole, n)
                left = np.flatnonzero(~gone)
                size = w.end[left] - w.begin[left]
                owner = np.searchsorted(w.at, left, "right") - 1
                last = np.ones(len(left), bool)
                last[:-1] = owner[1:] != owner[:-1]
                room = size + ~last  # a space after each word but a text's last, where white space follows
                data, stays = w.data.copy(), np.zeros(len(w.data) + 1, np.int8)
                data[w.end[left[~last]]] = 0x20
                stays[w.begin[left]] = 1
                stays[w.begin[left] + room] -= 1
                out = data[np.cumsum(stays[:-1], dtype=np.int8).view(bool)]
                edges = np.concatenate([[0], np.cumsum(np.bincount(owner, room, len(n)))]).astype(np.int32)
                kept = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(out))])
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.at])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(removed.astype(np.int64)), kept, part.column(4)], ["k", "t", "n_words", "n_removed", "kept", "all"])

    kind = source.schema["k"].dataType.simpleString()
    told = flagged.select("k", "t", "a", "b", "all", F.col("first").isNotNull().alias("copied"))
    n = hits.count()
    marked = hits.select("a", "b")
    none = F.lit(None).cast(hits.schema["hits"].dataType).alias("hits")
    if n <= BROADCAST_ROWS:  # texts without hits needn't move
        plain = told.join(F.broadcast(marked), ["a", "b"], "left_anti").select("k", "t", "copied", none, "all")
        rest = told.join(F.broadcast(marked), ["a", "b"], "left_semi").join(hits, ["a", "b"]).select("k", "t", "copied", "hits", "all")
        every = plain.unionByName(rest)
    else:
        every = told.join(hits, ["a", "b"], "left").select("k", "t", "copied", "hits", "all")
    out = every.mapInArrow(tidy(remove), f"k {kind}, t string, n_words long, n_removed long, kept string, all {source.schema['all'].dataType.simpleString()}")
    return out.select(F.col("k").alias(key), F.col("t").alias(text), "n_words", "n_removed", "kept", *([F.col("all").alias("row")] if carry else []))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
