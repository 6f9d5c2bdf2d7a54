"""A family of edited copies: pivots at its centre leave few pairs to be compared."""

import random

from covspark.llm import neardup, store


def test_a_family_of_edited_copies_needs_few_pairs(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]

    def edited():
        words = list(base)
        for i in r.sample(range(150), 3):
            words[i] = f"x{r.randrange(10**6)}"
        return " ".join(words)

    rows = [(i, edited()) for i in range(120)] + [(120, " ".join(base))]
    keep, made = store.Store.keep, []

    def counted(self, df, name):
        out = keep(self, df, name)
        if name.startswith("pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(store.Store, "keep", counted)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert ({x.component_id for x in got}, sum(made) <= 3 * len(rows)) == ({0}, True), made
