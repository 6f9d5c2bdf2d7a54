import numpy as np
from test_operators import brute_repeats

from covspark.llm import substrings
from covspark.llm.store import Store


def test_a_round_sends_buckets_of_keys(spark, monkeypatch):
    """Keys go through Spark by the bucket and segment, not each in a row of its own."""
    told, keep = {}, Store.keep

    def counted(store, df, name):
        out = keep(store, df, name)
        if name.startswith("told"):
            told[name] = out.count()
        return out

    monkeypatch.setattr(Store, "keep", counted)
    monkeypatch.setattr(substrings, "BUCKET_KEYS", 64, raising=False)  # 128 buckets
    same = " ".join(f"same{k}" for k in range(50))
    texts = [" ".join(f"w{i}x{k}" for k in range(2000)) + f" {same} end{i}" for i in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df).collect()}
    assert [got[i] for i in range(2)] == brute_repeats(texts) and got[0][1] == 50
    assert 0 < told["told0"] <= 2 * 128  # 4052 distinct words


def test_hashes_of_words():
    """A word's hashes depend on its bytes alone: not on what stands around it, and on each byte and the size."""
    base = bytes(range(97, 123)) * 20
    kinds = [base[:n] for n in (*range(1, 40), 127, 128, 129, 136, 137, 300)]
    kinds += [w[:k] + b"#" + w[k + 1 :] for w in (base[:7], base[:8], base[:9], base[:130], base[:300]) for k in range(len(w))]
    kinds += [b"\x01" * n for n in (1, 2, 8, 9, 127, 128, 129, 255, 256)]
    seen = []
    for gap in (b" ", b"\t \n"):
        data = np.frombuffer(gap + gap.join(kinds), np.uint8)
        size = np.array([len(w) for w in kinds])
        begin = len(gap) + np.cumsum(size + len(gap)) - size - len(gap)
        seen.append(substrings.word_hashes(data, begin, begin + size))
    for one, two in zip(*seen, strict=True):
        assert (one == two).all() and len(set(one.tolist())) == len(set(kinds))
    assert not (seen[0][0] == seen[0][1]).any()
