import random

import pyarrow as pa
from helpers import SCHEMA, frame, odd_rows, sentence, words

from skysift.llm.common import _give_back, release_executors, release_unused


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(5)
    rows = odd_rows()
    labels = []
    for k in range(100, 180):
        w = words(rng, 40)
        if k % 4 == 0:
            w[3] = w[20] = "vileword"
        rows.append((k, " ".join(w), "en", "src0", 1))
        labels.append((k, 1, int(k % 4 == 0)))
    passage = "\n".join(sentence(rng, 12) for _ in range(5))
    rows += [(200, passage, "en", "src1", 1), (201, passage + "\n" + sentence(rng, 9), "en", "src1", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        counts.append((name, before.count(), docs.count()))
        if name != "packing":
            assert docs.columns == before.columns
    assert [c[0] for c in counts] == ["toxicity", "line_dedup", "minhash", "mixing", "packing"]
    assert counts[0][2] < counts[0][1] and counts[1][2] == counts[1][1] and counts[2][2] <= counts[2][1]
    assert cp.run(spark, str(tmp_path)).count() == docs.count()


def test_every_stage_starts_with_memory_released(spark, monkeypatch):
    import corpus_pipeline as cp

    calls = []
    monkeypatch.setattr(cp, "release_unused", lambda s: calls.append(s))
    docs = frame(spark, odd_rows()[:4])
    for _, stage in cp.STAGES[3:]:
        stage(spark, docs, "")
    assert calls == [spark] * 2
    assert all(hasattr(stage, "__wrapped__") for _, stage in cp.STAGES)


def test_the_driver_gives_native_memory_back(spark):
    assert release_unused(spark)
    assert not release_unused(object())  # a session without a JVM of its own


def test_a_release_reaches_the_executors(spark):
    sc = spark.sparkContext
    beans = list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    collected = lambda: sum(b.getCollectionCount() for b in beans)
    sc.setJobGroup("release", "")
    try:
        assert release_unused(spark)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    (job,) = sc.statusTracker().getJobIdsForGroup("release")
    stages = [sc.statusTracker().getStageInfo(k) for k in sc.statusTracker().getJobInfo(job).stageIds]
    assert sum(x.numTasks for x in stages) == sc.defaultParallelism
    # In a local session the only executor is the driver's JVM.
    before = collected()
    assert release_executors(spark) == sc.defaultParallelism
    assert collected() > before


def test_stages_of_dataframe_functions_run_no_python(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp

    def never(*_, **__):
        raise AssertionError("Python on the executors")

    docs = frame(spark, [(k, f"line {k} of seven plain words here", "en", "src0", 1) for k in range(9)])
    monkeypatch.setattr(type(docs), "mapInArrow", never)
    stages = dict(cp.STAGES)
    assert stages["line_dedup"](spark, docs, "").count() == 9 and stages["mixing"](spark, docs, "").count() <= 9


def test_the_workers_give_back_where_python_runs(spark, monkeypatch):
    import corpus_pipeline as cp
    from skysift.llm.common import release_workers

    calls = []
    monkeypatch.setattr(cp, "release_unused", lambda s: calls.append("jvm"))
    monkeypatch.setattr(cp, "release_workers", lambda s: calls.append("workers"))
    docs = frame(spark, odd_rows()[:4])
    for _, stage in cp.STAGES[3:]:
        stage(spark, docs, "")
    assert calls == ["jvm", "workers", "jvm"]
    assert release_workers(spark) == spark.sparkContext.defaultParallelism


def test_a_worker_gives_back_and_keeps_its_rows():
    rows = [pa.RecordBatch.from_pydict({"id": [1, 2]}), pa.RecordBatch.from_pydict({"id": []}, pa.schema([("id", pa.int64())]))]
    assert list(_give_back(iter(rows))) == rows
