"""What a Python worker holds after a task, and the driver while it learns."""

import gc
import tracemalloc
import weakref

import pyarrow as pa

from tidewheel.llm import common, quality_classifier
from tidewheel.llm.common import lean
from tidewheel.llm.substring_dedup import Hashes


class _Held:
    pass


def test_a_worker_forgets_many_words_as_a_task_ends(monkeypatch):
    monkeypatch.setattr(common, "STAY", 10)
    hashes, refs = Hashes.of_worker(), []

    def run(batches):
        ring = _Held()
        ring.own = ring  # only the collector frees it
        refs.append(weakref.ref(ring))
        for b in batches:
            hashes.of(b.column(0).to_pylist())
            yield b

    batch = lambda n: pa.RecordBatch.from_arrays([pa.array([b"w%d" % k for k in range(n)], pa.binary())], ["w"])
    hashes.clear()
    gc.disable()
    try:
        few = hashes.of([b"w1"])[0]
        hashes.clear()
        assert len(list(lean(run)(iter([batch(7)])))) == 1 and len(hashes) == 7
        assert len(list(lean(run)(iter([batch(30)])))) == 1 and len(hashes) == 0
        assert [r() for r in refs] == [None, None] and Hashes.of_worker().of([b"w1"])[0] == few
    finally:
        gc.enable()


def test_the_sample_is_on_the_driver_once(spark):
    n = 2000
    docs = spark.createDataFrame([(k, f"some words {k} and {k % 7} more") for k in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(n)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        model = quality_classifier.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.labels) == n and peak < 1.6 * n * quality_classifier.TERMS * 4
