"""The pipeline, stage by stage, against plain Python over the same rows."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import _components_by_hand, _documents
from txrisk.llm import toxicity
from txrisk.session import scratch_path

SF = "/root/testdata/sf0.001"


def _by_id(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned, from the documents on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, found[-1], SF).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "ngram_jaccard_join", "decontamination", "packing",
    ]
    for stage in stages[1:-1]:
        assert stage.columns == stages[0].columns


def test_toxicity_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = toxicity.classify(stages[0], labels).filter("predicted = 1")
    assert set(_by_id(stages[1])) == set(_by_id(stages[0])) - {r["doc_id"] for r in rejected.collect()}


def test_exact_stage(stages):
    first = {}
    for i, t in sorted(_by_id(stages[1]).items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert set(_by_id(stages[2])) == set(first.values())


def test_near_stage(stages):
    groups = _components_by_hand(list(_by_id(stages[2]).items()), 5, 80)
    assert set(_by_id(stages[3])) == {least for _, least in groups.values()}


def test_benchmark_stage(spark, stages):
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 13]) for w in items for k in range(len(w) - 12)}

    def leaks(text):
        w = re.findall(r"\w+", text.lower())
        return any(tuple(w[k : k + 13]) in grams for k in range(len(w)))

    before, after = _by_id(stages[3]), _by_id(stages[4])
    assert set(after) == {i for i, t in before.items() if not leaks(t)}


def test_packing_stage(stages):
    whole = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of"))
    assert whole.filter("n <> of").isEmpty()
    assert {r["doc_id"] for r in whole.collect()} == set(_by_id(stages[4]))


def test_run_is_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "ids_crc32").collect()
    assert len(got) >= stages[4].count()


def test_stages_on_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, ""), (3, "x " * 5000)]
    for frame in (_documents(spark, rows), _documents(spark, [])):
        now = frame
        for _, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, "odd")
            stage(spark, now, SF).write.parquet(path)
            now = spark.read.parquet(path)
        assert now.isEmpty() == frame.isEmpty()
