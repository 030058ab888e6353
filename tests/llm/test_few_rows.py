"""Steps of few rows in few tasks, and components of few and of many edges."""

import random

import pytest

from tests.llm.test_operators import SCHEMA, _components, _cut, _kept, prose
from tidewheel.llm import jaccard_join, substring_dedup

rnd = random.Random(5)


@pytest.mark.parametrize("most", [0, 1000])
def test_components_of_few_and_of_many_edges(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "TASK_EDGES", most)
    path = [(k, k - 1) for k in range(60, 40, -1)]  # a chain, besides random edges, loops and repeated ones
    edges = path + [(a, a + rnd.choice([0, 1, 7])) for a in rnd.choices(range(100, 200), k=60)] + [(3, 3), (-5, 9), (9, -5)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["label"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: least[x] for x in joined}


def test_components_of_no_edges(spark):
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_rows_take_few_tasks(spark, monkeypatch):
    base, files, saved = prose(80).split(), {}, jaccard_join.saved

    def noted(df, name):
        out = saved(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard_join, "saved", noted)
    rows = [(k, " ".join([*base[: k % 40], f"w{k}", *base[k % 40 :], f"x{k // 2}"])) for k in range(120)]
    settings = {"spark.sql.shuffle.partitions": "41", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_components(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == _components(rows)
    assert {k: n for k, n in files.items() if n > spark.sparkContext.defaultParallelism and k not in ("join-sets", "join-common")} == {}


def test_few_repeats_take_few_tasks(spark, monkeypatch):
    base, files, saved = prose(400).split(), {}, substring_dedup.saved

    def noted(df, name):
        out = saved(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(substring_dedup, "saved", noted)
    rows = [(k, " ".join([*prose(5).split(), *base[k : k + 90], f"x{k // 2}"])) for k in range(200)]
    settings = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = _kept(substring_dedup.deduplicated(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == _cut(rows)
    # A table may be the union of two steps' rows; texts are read in all partitions.
    read = ("dedup-windows", "dedup-graph", "dedup-digests")
    assert {k: n for k, n in files.items() if n > 2 * spark.sparkContext.defaultParallelism and k not in read} == {}
