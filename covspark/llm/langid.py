"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, from any place in
a text, the longest match; a greedy parse cuts the text into such phrases. The
language that needs the fewest, normalised by length and by the logarithm of
its training text, wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import pieces, ranges, tidy
from .store import table

SAMPLE_PIECES = 32  # pieces of labelled texts that a language is learned from, at most, all of them read
PIECE = 1 << 10  # characters of a piece: a text is cut into such, from its first to its last
ALL_PIECES = 1 << 10  # of all languages together, or one of each if there are more
DENSE = 62  # the commonest letters of a language have columns in its table; its others are looked up by keys
SEGMENT = 256  # letters that are parsed at a time, beside other segments; their parses are then made one
TOGETHER = 4  # rounds in which all segments that are entered elsewhere are parsed anew side by side
GAP, UNKNOWN, BREAK = 0, 1, 2  # BREAK parts pieces, and no text has it


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    low = [x.lower() for x in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int64)


def symbols(texts: list[str | None], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of lower-cased texts, runs of other characters as one gap, and n + 1 offsets."""
    points, at = _points([x or "" for x in texts])
    s = codes[points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
    first = at[:-1][at[:-1] < at[1:]]
    keep[first] = s[first] != GAP
    kept = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], kept[at]


class Automaton(NamedTuple):
    """The suffix automaton of a language's sample, for greedy parsing.

    Entry [state, column] of table is 4 * width * next, plus one if a phrase starts
    at the symbol: at the root, and where the match breaks. The symbol then starts
    another match, or is a phrase of its own if it occurs nowhere.
    The language's letters beyond its DENSE commonest are ranked: their
    transitions are the sorted keys width * state * ranks + rank, with their
    entries, and fresh holds the entries of a break. A bound on states (twice the
    sample) and transitions (three times) bounds both, whatever the alphabet.
    """

    column: np.ndarray  # of each symbol; UNKNOWN for those that do not occur and those ranked
    rank: np.ndarray  # of each symbol, -1 for those not ranked; empty if none is
    table: np.ndarray
    keys: np.ndarray
    entries: np.ndarray
    fresh: np.ndarray

    def step(self, state: np.ndarray, column: np.ndarray, symbol: np.ndarray | None) -> np.ndarray:
        """The entries of states, each given as width * state, at symbols in columns; symbols where any is ranked."""
        v = self.table[state + column]
        if symbol is not None:
            rank = self.rank[symbol]
            rare = np.flatnonzero(rank >= 0)
            if len(rare):
                rank = rank[rare]
                key = state[rare].astype(np.int64) * len(self.fresh) + rank
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                v[rare] = np.where(self.keys[i] == key, self.entries[i], self.fresh[rank])
        return v


def automaton(s: list[int], kinds: int) -> Automaton:
    """The automaton of s, whose symbols are below kinds."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    counts = Counter(c for c in s if c != GAP)
    common = sorted(counts, key=lambda c: (-counts[c], c))
    common, ranked = common[:DENSE], common[DENSE:]
    width = 2 + len(common)
    column = np.full(kinds, UNKNOWN, np.uint8)
    column[[GAP, *common]] = [GAP, *range(2, width)]
    rank = np.full(kinds if ranked else 0, -1, np.int32)
    if ranked:
        rank[ranked] = np.arange(len(ranked))
    out = np.full((len(follow), width), -1, np.int64)
    sparse: list[tuple[int, int]] = []
    for state, to in enumerate(follow):
        for c, q in to.items():
            if ranked and rank[c] >= 0:
                sparse.append((width * state * len(ranked) + int(rank[c]), 4 * width * q + (state == 0)))
            else:
                out[state, column[c]] = q
    sparse.sort()
    fresh = out[0]
    again = np.where(fresh >= 0, 4 * width * fresh, 0) + 1
    whole = np.where(out >= 0, 4 * width * out, again)
    whole[0] = again
    keys, entries = np.array(sparse, np.int64).reshape(-1, 2).T.copy()
    starts = np.array([4 * width * follow[0][c] + 1 for c in ranked], np.int32)
    return Automaton(column, rank, whole.astype(np.int32).ravel(), keys, entries.astype(np.int32), starts)


def fit(samples: dict[str, list[str]]) -> tuple[list[str], np.ndarray, list[Automaton], list[int]]:
    """Languages in order, a symbol for each code point, an automaton and the training length of each.

    Every letter of a sample has a symbol of its own; only letters in none are UNKNOWN.
    """
    langs, plain = sorted(samples), _is_letter()
    letters: set[int] = set()
    for lang in langs:
        points, _ = _points(samples[lang])
        letters.update(np.unique(points[plain[points]]).tolist())
    kinds = 3 + len(letters)
    codes = np.where(plain, UNKNOWN, GAP).astype(np.min_scalar_type(kinds))
    codes[sorted(letters)] = np.arange(3, kinds, dtype=codes.dtype)
    tables, sizes = [], []
    for lang in langs:
        s, at = symbols(samples[lang], codes)
        s = np.insert(s, at[1:-1], BREAK).tolist()
        tables.append(automaton(s, kinds))
        sizes.append(max(2, len(s)))
    return langs, codes, tables, sizes


def _parse(s: np.ndarray, table: Automaton, begin: np.ndarray, stop: np.ndarray, limit: np.ndarray, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy parses that begin at the symbols begin, all at once: the places where phrases start, and
    for each parse the first such place at or after stop (limit, where the text ends first). With
    met, a parse ends as well where it comes to a place that is marked there."""
    exits, found = limit.copy(), []
    columns, ranked = table.column[s], len(table.rank) > 0
    own = np.flatnonzero(begin < limit)
    p, state, stop, limit = begin[own], np.zeros(len(own), np.int32), stop[own], limit[own]
    while len(own):
        v = table.step(state, columns[p], s[p] if ranked else None)
        start = (v & 1).astype(bool)
        over = p >= stop
        if met is not None:
            over |= met[p]
        over &= start
        if over.any():
            exits[own[over]] = p[over]
            left = ~over
            own, p, v, start, stop, limit = own[left], p[left], v[left], start[left], stop[left], limit[left]
        found.append(p[start])
        p, state = p + 1, v >> 2
        more = p < limit
        if not more.all():
            own, p, state, stop, limit = own[more], p[more], state[more], stop[more], limit[more]
    return np.concatenate([np.zeros(0, np.int64), *found]), exits


def _clear(marks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
    marks[ranges(begin, end - begin)] = False


def phrases(s: np.ndarray, at: np.ndarray, tables: list[Automaton]) -> np.ndarray:
    """Phrases of each text in each language, by one greedy parse of the whole text.

    Segments are parsed side by side as if each began a phrase. What follows from a
    phrase's start doesn't depend on what came before, so where the parse that enters
    a segment from the one before meets a start found there, the rest stands; up to
    there the segment is parsed anew, until no segment is entered elsewhere than it was.
    """
    n = np.diff(at)
    parts = -(-n // SEGMENT)
    owner = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, limit = at[:-1][owner] + nth * SEGMENT, at[1:][owner]
    stop = np.minimum(begin + SEGMENT, limit)
    out = np.zeros((len(n), len(tables)), np.int64)
    for k, table in enumerate(tables):
        started = np.zeros(len(s) + 1, bool)
        found, exits = _parse(s, table, begin, stop, limit)
        started[found] = True
        entered, rounds = begin.copy(), 0
        while True:
            entry = np.where(nth > 0, np.concatenate([[0], exits[:-1]]) if len(exits) else exits, begin)
            todo = np.flatnonzero(entry != entered)
            if not len(todo):
                break
            rounds += 1
            if rounds > TOGETHER:  # texts with a period may never meet: each is parsed on from its first open segment
                todo = todo[np.unique(owner[todo], return_index=True)[1]]
                found, met = _parse(s, table, entry[todo], limit[todo], limit[todo], started)
                _clear(started, begin[todo], met)
                started[found] = True
                last = todo - nth[todo] + np.minimum((met - at[:-1][owner[todo]]) // SEGMENT, parts[owner[todo]] - 1)
                passed = ranges(todo, last - todo + 1)
                places = np.append(np.flatnonzero(started), len(s))
                entered[passed] = np.minimum(places[np.searchsorted(places, begin[passed])], limit[passed])
                passed = ranges(todo, last - todo + (met == limit[todo]))
                exits[passed] = np.minimum(places[np.searchsorted(places, stop[passed])], limit[passed])
                continue
            entered[todo] = entry[todo]
            found, met = _parse(s, table, entry[todo], stop[todo], limit[todo], started)
            same = met < stop[todo]  # the rest stands, and with it where the segment is left
            exits[todo[~same]] = met[~same]
            _clear(started, begin[todo], np.minimum(met, stop[todo]))
            started[found] = True
        sums = np.concatenate([[0], np.cumsum(started)])
        out[:, k] = sums[at[1:]] - sums[at[:-1]]
    return out


def _samples(rows: DataFrame) -> dict[str, list[str]]:
    """Pieces of the labelled texts of each language: those whose key and place hash lowest. Their number is bounded."""
    good = rows.where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}")).select("l", "k", "t", F.xxhash64("t").alias("h"))
    langs = good.select("l").distinct().count()
    if not langs:
        return {}
    most = max(1, min(SAMPLE_PIECES, ALL_PIECES // langs))
    places = good.selectExpr("l", "k", "h", f"explode(sequence(0, (length(t) - 1) div {PIECE})) AS i").distinct()
    nth = F.row_number().over(W.partitionBy("l").orderBy(F.xxhash64("k", "h", "i"), "k", "h", "i"))
    asked = places.withColumn("nth", nth).where(F.col("nth") <= most).select(F.col("l").alias("lang"), F.col("k").alias("key"), F.col("h").alias("hash"), "i")
    got = good.join(F.broadcast(asked), (F.col("l") == F.col("lang")) & (F.col("k") == F.col("key")) & (F.col("h") == F.col("hash")))  # at most ALL_PIECES rows, or the languages
    got = got.selectExpr("l", "k", "h", "i", f"substring(t, int(i * {PIECE} + 1), {PIECE}) AS t").distinct().toPandas().sort_values(["l", "k", "h", "i"])
    return {x: own["t"].tolist() for x, own in got.groupby("l")}


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", carry: bool = False) -> DataFrame:
    """key, held_out, lang_pred, score for every row; with carry, a struct of all of docs' columns, row, and whether the text has a letter, lettered, too.

    Learned from rows with a lang whose crc32(key as text) mod 5 is not 0: their texts
    are cut into pieces of PIECE characters, of which SAMPLE_PIECES of each lang are
    read, chosen by hash (fewer if langs are many: ALL_PIECES of all), so the tables
    have a bound. Predictions see the text only.
    score is h2 / (h1 + h2) for the least and second-least bits a symbol, h: 0.5
    where they tie, 1 where there is one language. Ties go to the first in
    alphabetical order. A null text, or one without letters, is `und` with score 0,
    as all texts are when nothing can be learned. A null key is neither held out
    nor learned from. Rows that repeat have results of their own; no rows give none.
    """
    spark = docs.sparkSession
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.lit(True)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"), whole.alias("row"))
    part = F.crc32(F.col("k").cast("string")) % 5
    samples = _samples(rows.where(part != 0))
    shared = spark.sparkContext.broadcast(fit(samples)) if samples else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, codes, tables, sizes = shared.value if shared else ([], np.where(_is_letter(), UNKNOWN, GAP).astype(np.uint8), [], [])
        weight = np.log2(np.array(sizes, float))
        for batch in batches:
            if carry:
                batch = batch.set_column(1, "t", batch.column(2).field(text))
            for piece in pieces(batch, "t", 1 << 20):
                s, at = symbols(piece.column(1).to_pylist(), codes)
                lettered = np.concatenate([[0], np.cumsum(s != GAP)])
                has = lettered[at[1:]] > lettered[at[:-1]]
                known = has & bool(langs)
                if langs:
                    bits = phrases(s, at, tables) * weight / np.maximum(1, np.diff(at))[:, None]
                    best = bits.argmin(1)
                    low = np.sort(bits, 1)
                    score = low[:, 1] / np.maximum(low[:, 0] + low[:, 1], 1e-300) if len(langs) > 1 else np.ones(len(piece))
                else:
                    best, score = np.zeros(len(piece), int), np.zeros(len(piece))
                names = np.array([*langs, "und"], object)[np.where(known, best, len(langs))]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(has), piece.column(2)], ["k", "lang_pred", "score", "lettered", "row"])

    kind = rows.schema["k"].dataType.simpleString()
    lean = rows.select("k", F.lit(None).cast("string").alias("t"), "row") if carry else rows.select("k", "t", "row")  # a carried text is sent once
    found = lean.mapInArrow(tidy(run), f"k {kind}, lang_pred string, score double, lettered boolean, row {rows.schema['row'].dataType.simpleString()}")
    return found.select(F.col("k").alias(key), F.coalesce(part == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", *(["row", "lettered"] if carry else []))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
