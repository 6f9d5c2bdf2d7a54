"""Token counts of sections, by the place of tokens in the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PIECE, Encoder, Vocabulary, load_ranks
from .scan import pieces, tidy, utf8
from .store import table

RULES = ("first", "last", "most")


def attribute(begin: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token [begin, end), and whether it crosses a boundary.

    Sections are [edges[i], edges[i + 1]), in order and without gaps. A crossing
    token goes whole to the section of its first or last byte, or to the one that
    has most of its bytes (the first of these on ties).
    """
    first = np.searchsorted(edges, begin, "right") - 1
    last = np.searchsorted(edges, end - 1, "right") - 1
    crosses = first != last
    out = {"first": first, "last": last, "most": first}[rule].copy()
    if rule == "most":
        for i in np.flatnonzero(crosses):
            held = [min(end[i], edges[s + 1]) - max(begin[i], edges[s]) for s in range(first[i], last[i] + 1)]
            out[i] = first[i] + int(np.argmax(held))
    return out, crosses


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, rule: str = "most", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section, char_begin, char_end, n_tokens, n_crossing: one row for each line of each text.

    Whole texts are encoded once; a line holds the line end that closes it. Each
    token is joined to lines by its span in the text, and one that crosses a
    boundary is counted once, where rule says (see attribute); n_crossing counts
    those among n_tokens. Counts of a text's lines add up to its tokens. Null and
    empty texts have one empty section. Repeated rows have rows of their own; an
    empty table gives none; other columns play no part, whatever their names.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        width = np.array([len(b or b"") for b in shared.value.names()], np.int64)
        for batch in batches:
            for part in pieces(batch, "t", PIECE):
                ids, at = encoder.encode(part.column(1).to_pylist())
                data, edge = utf8(part.column(1))
                n = len(part)
                ends = np.concatenate([[0], np.cumsum(width[ids])])  # bytes: texts follow one another
                line = np.flatnonzero(data == 10) + 1
                line = line[~np.isin(line, edge)]
                edges = np.sort(np.concatenate([edge[:-1], line]), kind="stable")
                begins = np.searchsorted(edges, edge, "left")  # an empty text's section starts where the next text's does
                begins[:-1] = np.arange(n) + np.searchsorted(line, edge[:-1], "left")
                begins[-1] = len(edges)
                bounds = np.concatenate([edges, [len(data)]])
                section, crosses = attribute(ends[:-1], ends[1:], bounds, rule)
                owner = np.repeat(np.arange(n), np.diff(begins))
                tokens = np.bincount(section, minlength=len(edges))
                crossing = np.bincount(section[crosses], minlength=len(edges))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = chars[edge[:-1]][owner]
                nth = np.arange(len(edges)) - begins[:-1][owner]
                columns = [part.column(0).take(pa.array(owner)), pa.array(nth.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (chars[bounds[:-1]] - base, chars[bounds[1:]] - base, tokens, crossing))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "section", "char_begin", "char_end", "n_tokens", "n_crossing"])

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"k {kind}, section int, char_begin long, char_end long, n_tokens long, n_crossing long").withColumnRenamed("k", key)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return count_tokens(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
