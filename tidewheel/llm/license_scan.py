"""License scans by an exact set-similarity join of text blocks with templates.

A block is a stretch of a document's words, a template the words of a license notice; they match when the block
holds at least `threshold` of the template's distinct words. Blocks are at least twice as long as the template and
begin every half block, so that a notice lies in one wherever it stands; templates of like length share their blocks. The join is exact and small because of three filters
over one global order of the words, rarest in the corpus first: a match shares one of the template's first
n - ceil(threshold * n) + 1 words (prefix), the block has at least that many words (length), and from the first
shared word on both still have enough of them (position). Blocks without a template's prefix word never leave the
scan.

Phrases are found beside it, as consecutive words of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of
from .license_texts import NOTICES

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
THRESHOLD = 0.85
#: Words of the shortest blocks.
LEAST_BLOCK = 32

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. UTF-8 keeps other characters whole."""
    return text.translate(_WORD).split()


def phrase_starts(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    heads = {p[0] for p in phrases}
    out = []
    if any(h in words for h in heads):
        for i, w in enumerate(words):
            if w in heads:
                out += [(i, label) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
    return out


def needed(n: int, threshold: float) -> int:
    """Shared words that a template of n distinct words asks for."""
    return math.ceil(threshold * n - 1e-9)


def block_size(n: int) -> int:
    """Words of the blocks for a template of n words: a power of two, half of which holds the template."""
    return max(LEAST_BLOCK, 1 << (2 * n - 1).bit_length())


def block_starts(n: int, size: int) -> range:
    """Where the blocks of a text of n words begin. Any size // 2 consecutive words lie in one."""
    return range(0, max(1, n - size // 2), size // 2)


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that have each word, over all documents; words that none has count 0."""
    wanted = {w.encode() for w in vocabulary}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, int] = {}
            for text in batch.column(0).to_pylist():
                for w in wanted.intersection(words_of(text)):
                    found[w] = found.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    got = docs.select(text_of().cast("binary")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in got}


ROWS = "doc_id long, row long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<size:int,words:array<int>>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best containment of a template in a block, where it meets the threshold, and 1 with a phrase; else
    0. Null text counts as empty: no words, no labels. Repeated rows give repeated results; an empty table none."""
    spark = docs.sparkSession
    split = [(label, [w.decode() for w in words_of(t.encode())]) for label, t in templates]
    sets = [(label, sorted(set(w)), block_size(len(w))) for label, w in split]
    frequency = word_frequencies(docs, sorted({w for _, s, _ in sets for w in s}))
    order = {w: k for k, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
    ranked = [(label, sorted(order[w] for w in s), size) for label, s, size in sets]
    prefix = lambda s: s[: len(s) - needed(len(s), threshold) + 1]
    prefixes = {size: {w for _, s, z in ranked if z == size for w in prefix(s)} for _, _, size in ranked}
    least = {size: min(needed(len(s), threshold) for _, s, z in ranked if z == size) for size in prefixes}
    rank = {w.encode(): k for w, k in order.items()}
    rare = {w for w, k in rank.items() if any(k in p for p in prefixes.values())}
    as_words = {tuple(p.encode().split()): label for p, label in phrases.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                starts = phrase_starts(words, as_words)
                blocks = set()
                if not rare.isdisjoint(words):
                    known = [rank.get(w, -1) for w in words]
                    for size, of in prefixes.items():
                        if of.isdisjoint(known):
                            continue
                        for a in block_starts(len(words), size):
                            found = set(known[a : a + size]) - {-1}
                            if len(found) >= least[size] and not of.isdisjoint(found):
                                blocks.add((size, tuple(sorted(found))))
                at = [i for i, _ in starts]
                rows.append((doc, row, len(words), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in starts}), [{"size": z, "words": list(b)} for z, b in blocks]))
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = [pa.int64()] * 6 + [pa.list_(pa.string()), pa.list_(pa.struct([("size", pa.int32()), ("words", pa.list_(pa.int32()))]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "row", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    # row tells rows of one doc_id apart; rows that share it have the same text, and so the same matches.
    rows = saved(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), text_of().cast("binary").alias("text")).mapInArrow(run, ROWS), "license-rows")
    wanted = spark.createDataFrame(
        [(k, label, size, s, len(s), needed(len(s), threshold), w, at + 1) for k, (label, s, size) in enumerate(ranked) for at, w in enumerate(prefix(s))],
        "template int, label string, size int, words array<int>, n int, needed int, word int, at int",
    )
    blocks = rows.select("doc_id", "row", F.explode("blocks").alias("b")).select("doc_id", "row", "b.size", F.col("b.words").alias("block")).distinct()
    joined = blocks.select("*", F.posexplode("block").alias("block_at", "word")).join(F.broadcast(wanted), ["size", "word"])
    able = joined.filter(F.size("block") >= F.col("needed")).filter(F.least(F.col("n") - F.col("at"), F.size("block") - F.col("block_at") - 1) + 1 + F.least(F.col("at") - 1, F.col("block_at")) >= F.col("needed"))
    shared = F.size(F.array_intersect("block", "words"))
    matches = able.withColumn("shared", shared).filter(F.col("shared") >= F.col("needed")).groupBy("doc_id", "row").agg(F.collect_set("label").alias("own"), F.max(F.col("shared") / F.col("n")).alias("containment"))
    out = rows.drop("blocks").join(matches.withColumnRenamed("doc_id", "_d").withColumnRenamed("row", "_r"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
    labels = F.array_union("base_labels", F.coalesce("own", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
