import corpus_pipeline
import pytest
from pyspark import SparkContext

from covspark.llm import decontam, langid


@pytest.fixture
def few(spark):
    rows = [(i, f"{word} the quick brown fox jumps over the lazy dog and runs far away {i}", lang) for i, (word, lang) in enumerate([("one", "en"), ("deux", "fr"), ("drei", "de"), ("four", "en")] * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_no_rows_of_python_objects(spark, few, monkeypatch):
    """They would go through Python workers of another kind, which an executor keeps beside those of the operators."""
    bench = spark.createDataFrame([("a", "quick brown fox jumps over the lazy dog and runs far")], "item_id string, text string")

    def refuse(*_, **__):
        raise AssertionError("rows of Python objects")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    assert {r.lang_pred for r in langid.identify(few).collect()} <= {"en", "fr", "de"}
    assert [r.n_hit for r in decontam.decontaminate(few, bench).collect()] == [11] * 12


def test_a_search_has_one_python_worker_a_task(spark, few):
    bench = spark.createDataFrame([("a", "brown fox")], "item_id string, text string")
    plan = decontam.decontaminate(few, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and " MapInArrow" not in plan


def test_stages_begin_with_swept_executors(spark, few, tmp_path):
    """What a stage leaves in the executors' heaps doesn't add to the next one's. Here the executor is the driver."""
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    for stage in (corpus_pipeline.language, corpus_pipeline.tokens):  # the others sweep this heap for its shuffle files too
        before = sum(b.getCollectionCount() for b in beans)
        stage(spark, few, str(tmp_path))
        assert sum(b.getCollectionCount() for b in beans) > before
