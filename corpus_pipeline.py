"""A corpus pipeline: five operators of tidewheel.llm, each working on all that the one before kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import jaccard_join, language_id, packing, quality_classifier, substring_dedup
from tidewheel.llm.common import having, keyed, saved, short_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Posterior that a language needs; below it, and for `und`, language ID rejects a document.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found, with that language as lang."""
    short_batches(spark)
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    named = language_id.identify(docs, model, keep=COLUMNS)
    return named.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the labelled neighbours vote for."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, keep=COLUMNS).filter(F.col("score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of linked documents the one with the smallest doc_id; of rows that share it, one. Rows
    without doc_id come after all others."""
    rows, _ = keyed(docs.select(*COLUMNS))
    linked = jaccard_join.linked_components(rows.select(F.col("_row").alias("doc_id"), "text"))
    near = saved(linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("_row")), "pipeline-near")
    return having(rows, near, "_row", kept=False).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller doc_id has; a document without a cut keeps its text as it is, one
    without words left goes. Rows that share a doc_id are each cut, rows without one aren't."""
    rows, unique = keyed(docs.select(*COLUMNS))
    spans = saved(substring_dedup.repeated_spans(rows, unique=unique), "pipeline-spans")
    cut = substring_dedup.without_spans(having(rows, spans, "_row"), spans, keep=("doc_id", "lang", "source")).filter("n_words > n_removed")
    cut = cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))
    return having(rows, spans, "_row", kept=False).select(*COLUMNS).unionByName(cut)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Language ID, the classifier and the tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"pipeline-{name}")
    return docs
