"""The pipeline's stages against plain Python on a small corpus."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import _components, split

rnd = random.Random(21)
WORDS = {"en": ["the", "and", "there", "with", "house", "garden", "water", "thing", "other", "which", "would", "about"], "de": ["der", "und", "nicht", "haus", "garten", "wasser", "welche", "zwischen", "über", "schule", "ihre", "strasse"]}


def prose(lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "en", "er", "s", "ly", "ung"]) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    passage, rows = prose("en", 60), []
    for k in range(60):
        lang = "de" if k % 3 == 0 else "en"
        text = prose(lang, 90)
        if k in (10, 11, 40):
            text = f"{text} {passage} {prose(lang, 20)}"
        rows.append((k, text, lang, "s", len(text)))
    rows += [(60, rows[4][1], "en", "s", 1), (61, rows[4][1] + " end", "en", "s", 1), (62, None, "en", "s", 0), (63, "1234 !!", "en", "s", 7)]
    rows += [(k, "### %%% &&& " * 60, "en", "s", 1) for k in range(64, 84)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k < 64), 0) for k in range(84) if k % 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"]: r for r in docs.collect()} if k < 4 else docs.collect())
        assert k == 4 or tuple(docs.columns) == corpus_pipeline.COLUMNS
    language, quality, near, cut, packed = kept
    assert set(range(62)) <= set(language) and not {62, 63} & set(language)
    assert all(language[k]["lang"] == ("de" if k % 3 == 0 else "en") for k in range(60))
    assert set(range(62)) == set(quality)
    texts = [(i, r["text"]) for i, r in sorted(quality.items())]
    assert set(near) == {c for _, c in _components(texts).values()} and not {60, 61} & set(near)
    first = {}
    for i, r in sorted(near.items()):
        w = split(r["text"])
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for i, r in near.items():
        w = split(r["text"])
        gone = {j + n for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for n in range(50)}
        want = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r["text"]
        assert cut[i]["text"] == want and (not gone or cut[i]["n_chars"] == len(want))
    assert {r["doc_id"] for r in packed} == set(cut)
    for s in {r["sequence_id"] for r in packed}:
        assert sum(r["length"] for r in packed if r["sequence_id"] == s) <= 1024
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)


def test_stages_on_odd_tables(spark, sf_dir, tmp_path):
    """Repeated rows, ids with two texts or none, null texts, columns beside those of documents, and no rows at all."""
    base, other, shared = prose("en", 120), prose("en", 100), prose("en", 60)
    texts = [(1, base), (1, base), (2, base + " end"), (3, other), (3, shared + " " + prose("en", 30)), (4, prose("en", 30) + " " + shared), (None, other + " more"), (None, None), (9, prose("de", 80))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or ""), k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, _row long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k == 1:
            assert sorted(r["source"] for r in rows) == ["s0", "s1", "s2", "s3", "s4", "s5", "s6", "s8"]
        if k == 2:  # one of s0, s1 and s2, and s3 but not the row without an id that is like it
            assert len(rows) == 5 and {r["source"] for r in rows} >= {"s3", "s4", "s5", "s8"}
        if k == 3:
            assert len(rows) == 5 and next(r["text"] for r in rows if r["source"] == "s5") == " ".join(split(texts[5][1])[:30])
    assert {r["doc_id"] for r in rows} == {1, 3, 4, 9}
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, none, sf_dir)
        assert none.count() == 0
