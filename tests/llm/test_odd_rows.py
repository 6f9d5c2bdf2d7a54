"""Null keys, repeated rows and columns named as operators name their own: every row has its result."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from covspark.llm import ann, bpe, chat, decontam, langid, neardup, quality, shards, substrings, tokencount

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, "one two"), (1, "one two"), (1, LONG), (None, LONG), (None, None), (2, None), (3, ""), (3, LONG + " more"), (4, "é" * 50)]
CLASH = ["k", "t", "row", "all", "first", "a", "n", "id", "host", "range", "gone", "copied", "hits", "key", "size"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in ROWS], "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).cache()


def test_every_row_has_a_result(spark, odd):
    ranks, pattern = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    bench = spark.createDataFrame([(1, "w5 w6 w7", "x"), (None, None, "x")], "item_id long, text string, k string")
    labels = spark.createDataFrame([(1, 1, "x"), (None, 0, "x"), (4, 0, "x")], "doc_id long, quality int, k string")
    made = {
        "decontaminate": decontam.decontaminate(odd, bench),
        "substrings": substrings.remove_repeats(odd, carry=True),
        "quality": quality.score(odd, labels, F.col("source"), F.col("lang")),
        "near": neardup.near_duplicates(odd),
        "language": langid.identify(odd, carry=True),
        "shards": shards.shard(odd),
        "bpe": bpe.round_trip(odd, ranks, pattern),
    }
    for name, df in made.items():
        assert df.count() == len(ROWS), name
    assert tokencount.count_tokens(odd, ranks, pattern).count() == len(ROWS)
    got = [(r.n_hit, r["items"]) for r in made["decontaminate"].collect()]
    assert sum(h for h, _ in got) == 9 and sorted(map(tuple, (i for _, i in got))).count(("1",)) == 3
    assert {(r.doc_id, r.n_removed) for r in made["substrings"].collect()} == {(1, 0), (1, 60), (None, 60), (None, 0), (2, 0), (3, 0), (3, 60), (4, 0)}
    near = made["near"].collect()
    assert all(r.kept and r.component_id is None for r in near if r.doc_id is None)
    assert all(r.component_id == 1 for r in near if r.doc_id == 1)
    assert all(r.component_id == 1 for r in near if r.doc_id == 3)  # its long text is near that of 1


def test_near_duplicates_of_repeated_and_other_keys(spark):
    """Texts of one key are one document, which has all their links; keys may be text."""
    say = lambda p: " ".join(f"{p}{i}" for i in range(40))
    rows = [("1", say("a")), ("1", say("b")), ("2", say("a") + " x"), ("3", say("b") + " y"), ("4", say("c")), ("5", ""), ("1", None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [("1", "1")] * 3 + [("2", "1"), ("3", "1"), ("4", "4"), ("5", "5")]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_pipeline_judges_rows_by_their_texts(spark, tmp_path):
    import corpus_pipeline

    say = lambda p: " ".join(f"{p}{i}" for i in range(40))
    rows = [(1, say("a")), (1, say("b")), (1, say("b")), (None, say("a") + " x"), (None, say("c")), (None, say("c")), (7, say("c") + " z"), (8, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, say("a")), (1, say("b")), (7, say("c") + " z"), (8, "")])


def test_chats_and_vectors_of_odd_rows(spark):
    turns = [(1, 0, "user", "a"), (1, None, "user", "first"), (1, 0, "user", "a"), (None, 1, None, None), (2, 5, "assistant", None)]
    talks = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").select("*", *(F.lit("clash").alias(c) for c in ("c", "n", "r", "t", "formatted")))
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_chats(talks).collect()}
    assert got == {1: [("user", "first"), ("user", "a"), ("user", "a")], None: [("", "")], 2: [("assistant", "")]}
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (None, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (100, [1.0, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").select("*", *(F.lit("clash").alias(c) for c in ("id", "v", "code", "norm", "score", "rank")))
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]


def test_a_text_of_several_pieces(spark):
    """One text of over 4 MB: more than any operator handles at once."""
    body = " ".join(f"w{i % 5000}x{i % 7}" for i in range(560_000))
    text = body + " " + LONG + " tail " + LONG
    assert len(text) > 4 << 20
    df = spark.createDataFrame([(1, text), (2, LONG), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w57 w58 w59 tail w0")], "item_id long, text string")
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.decontaminate(df, bench).collect()}
    assert hit == {1: (560_121, 5), 2: (60, 0), 3: (0, 0)}
    left = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect()}
    assert left == {1: (560_121, 560_120), 2: (60, 60), 3: (0, 0)}  # the body has a period of 35,000 words
    near = {r.doc_id: r.n_shingles for r in neardup.near_duplicates(df).collect()}
    said = text.split()
    assert near[2] == 56 and near[1] == len(set(zip(*(said[i:] for i in range(5)), strict=False)))
    ranks, pattern = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    told = {r.doc_id: r.decoded_sha256 for r in bpe.round_trip(df, ranks, pattern).collect()}
    assert told[1] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages_keep_columns(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "w5 w6 w7")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == odd.columns
        assert docs.where("k <> 'clash' OR k IS NULL").count() == 0
    assert sorted(r.text for r in docs.collect()) == ["one two", "é" * 50]


def test_pipeline_keeps_texts_when_no_language_is_known(spark, tmp_path):
    import corpus_pipeline

    data = [(1, "one two", None), (2, "123 !?", None), (3, None, None), (4, "é", None), (None, "word", None), (None, "other", "xx")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = corpus_pipeline.language(spark, docs.where("lang IS NULL"), str(tmp_path)).collect()
    assert sorted(r.text for r in got) == ["one two", "word", "é"] and {r.lang for r in got} == {None}
    got = corpus_pipeline.language(spark, docs.where("doc_id IS NULL"), str(tmp_path)).collect()
    assert sorted((r.text, r.lang or "") for r in got) == [("other", "xx"), ("word", "")]
