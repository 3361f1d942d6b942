"""What a step leaves behind in executors that later steps share."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa

import corpus_pipeline
from txrisk.llm import decontaminate, exact, jaccard, packing
from txrisk.llm.common import give_back
from txrisk.llm.queries import tokenizer_path
from txrisk.session import materialise


def _own_mb() -> float:
    rollup = Path("/proc/self/smaps_rollup").read_text()
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", rollup))) / 1024


def test_a_task_hands_back_what_it_freed():
    left = []

    def run(batches):
        for batch in batches:
            held = [bytes(1000) for _ in range(200_000)]
            left.extend(held[::1000])  # little stays, all over the heap
            yield batch

    before = _own_mb()
    assert list(give_back(run)(iter([1, 2]))) == [1, 2]
    assert _own_mb() - before < 50


def _open_stores(spark) -> int:
    kind = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$")
    (field,) = [f for f in kind.getDeclaredFields() if f.getName().endswith("loadedProviders")]
    field.setAccessible(True)
    return field.get(kind.getField("MODULE$").get(None)).size()


def test_no_state_store_stays_open_after_the_stream(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string").write.parquet(path)
    before = _open_stores(spark)
    assert exact.deduplicate(spark, path).filter("kept").count() == 7
    assert _open_stores(spark) <= before


def test_a_task_of_the_join_holds_one_python_worker(spark, monkeypatch):
    plans = {}

    def noted(frame, name):
        plans.setdefault(name, frame._jdf.queryExecution().executedPlan().toString())
        return materialise(frame, name)

    monkeypatch.setattr(jaccard, "materialise", noted)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words, "end"]), "something else", None, "", " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {tuple(r) for r in jaccard.join_components(docs).collect()}
    assert found == {(0, 58, 0), (1, 59, 0), (2, 1, 2), (3, 0, 3), (4, 0, 4), (5, 58, 0)}
    assert plans["incidence"].count("MapInArrow") == 1
    shuffled = jaccard.join_components(docs, jaccard.Settings(broadcast_rows=0))
    assert {tuple(r) for r in shuffled.collect()} == found


def test_words_in_use_stay_known_when_the_table_is_full(monkeypatch):
    made, learnt = packing.Encoder(packing.Settings(tokenizer_path(), cached_bytes=0)), []
    learn = made._learn
    monkeypatch.setattr(made, "_learn", lambda new: (learnt.append(sorted(new)), learn(new)))
    found = ["Some plain words, naïve ones", "some other words", "some other words"]
    for text in found:
        assert made.encode([text]) == [made._ids(text).tobytes()]
    assert learnt == [sorted({",", "some", "plain", "words", "naïve", "ones"}), ["other"], []]
    assert made.known.keys() == {"some", "other", "words"}


def test_workers_that_pack_hold_no_pandas():
    loads = "import sys, pyspark.worker, txrisk.llm.packing; sys.exit('pandas' in sys.modules)"
    root = Path(packing.__file__).parents[2]
    assert subprocess.run([sys.executable, "-c", loads], cwd=root).returncode == 0


def test_packing_takes_few_texts_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    run = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f) or self)
    settings = packing.Settings(tokenizer_path(), block_tokens=3000, text_bytes=20_000)
    packing.pack_documents(docs, settings)
    taken, encode = [], packing.Encoder.encode
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, found: taken.append(sum(map(len, found))) or encode(self, found))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = [("some words " * 90) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(200), pa.int64()), "text": rows})
    packed = pa.Table.from_batches(list(run[0](iter([batch]))))
    assert len(taken) >= 9 and max(taken) <= 20_000 and sum(taken) == sum(map(len, rows))
    assert set(packed["doc_id"].to_pylist()) == set(range(200))


def _full_collections(spark) -> int:
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))


def test_each_stage_begins_with_collected_heaps(spark, monkeypatch):
    before = _full_collections(spark)
    corpus_pipeline.give_heap_back(spark)
    assert _full_collections(spark) > before
    begun = []
    monkeypatch.setattr(corpus_pipeline, "give_heap_back", lambda spark: begun.append(1))
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline.packing, "pack_documents", lambda docs, settings: docs)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "") is docs and begun == [1]


def test_seeds_and_alignments_carry_no_words(spark, monkeypatch):
    """An item of 3,000 words has 15,000 seeds; with its words in each they would take gigabytes."""
    written, sides = {}, []
    monkeypatch.setattr(decontaminate, "materialise", lambda frame, name: written.setdefault(name, materialise(frame, name)))
    seeds = decontaminate._seeds
    monkeypatch.setattr(decontaminate, "_seeds", lambda *a: sides.append(seeds(*a)) or sides[-1])
    item = [f"w{k * k % 1009}x{k}" for k in range(3000)]
    rows = [(1, " ".join(["pre"] * 5 + item)), (2, " ".join(item[100:2900])), (2, " ".join(item[100:2900])), (3, "pre other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item[:20]))], "item_id long, text string")
    found = {tuple(r) for r in decontaminate.leaks(docs, bench).drop("text_key").collect()}
    assert found == {(1, 7, 5, 3000, 3000, 3000, 13), (1, 7, 5, 20, 20, 20, 13), (2, 7, -100, 3000, 2800, 2800, 13)}
    theirs, ours = sides
    assert theirs.columns == ["item_id", "item_key", "at", "mask", "seed"]
    assert ours.columns == ["doc_id", "text_key", "at", "mask", "seed"]
    assert written["alignments"].columns == ["doc_id", "text_key", "item_id", "item_key", "shift"]
    assert written["alignments"].count() == 3


def test_texts_stay_where_they_are_when_few_leak(spark):
    words = [f"i{k}" for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "other text"), (None, " ".join(words)), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    kept = decontaminate.drop_leaking(docs.repartition(4), bench)
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
    shuffled = decontaminate.drop_leaking(docs, bench, decontaminate.Settings(broadcast_seeds=0, broadcast_bytes=0))
    for frame in kept, shuffled:
        assert sorted(map(tuple, frame.collect()), key=str) == [(2, "other text"), (None, None)]
