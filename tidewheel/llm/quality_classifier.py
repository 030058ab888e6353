"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (hashed into a fixed number of cells), its trigrams of character classes, and a few marks
of repetition and length. Weighted counts of a
bounded labelled sample give the space (a truncated SVD); the labelled vectors are then broadcast, and every
document's cosine with every one of them is computed, a block of documents at a time. The nearest vote for their
labels, weighted by similarity. Similarities are compared to six decimals; of equal ones those of smaller doc_id vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of
from .substring_dedup import Hashes

#: Labelled documents that are broadcast, about at most.
TRAIN_ROWS = 4000
DIMENSIONS = 32
NEIGHBOURS = 15
#: Similarities count to this power.
SHARPNESS = 8
THRESHOLD = 0.7
BLOCK = 128

#: Classes of bytes: other letters, digits and marks; then each of these by itself.
MARKS = b" \n!#$%&*|.,"
_OTHER, _LOWER, _UPPER, _DIGIT, _HIGH = range(5)
CLASS = np.full(256, _OTHER, np.int64)
CLASS[ord("a") : ord("z") + 1] = _LOWER
CLASS[ord("A") : ord("Z") + 1] = _UPPER
CLASS[ord("0") : ord("9") + 1] = _DIGIT
CLASS[128:] = _HIGH
for _k, _c in enumerate(MARKS):
    CLASS[_c] = 5 + _k
N_CLASSES = 5 + len(MARKS)
TRIGRAMS = N_CLASSES**3
#: Marks of a text as a whole, each in so many steps.
STEPS = 10
#: Cells that words are hashed into, a power of two.
CELL_BITS = 10
TERMS = TRIGRAMS + 3 * STEPS + (1 << CELL_BITS)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def term_counts(text: str) -> np.ndarray:
    """Counts of a whole text's terms; an empty text has only its length's."""
    raw = text.encode()
    c = CLASS[np.frombuffer(raw, np.uint8)]
    out = np.zeros(TERMS, np.float32)
    if len(c) > 2:
        out[:TRIGRAMS] = np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=TRIGRAMS)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    threes = max(0, len(words) - 2)
    again = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / threes if threes else 0
    same = 1 - len(set(lines)) / len(lines) if lines else 0
    # As weighty as the rest of the text: these say of all of it what trigrams can't.
    weight = max(1, len(c))
    for k, share in enumerate((again, same, min(1, np.log2(1 + len(words)) / 16))):
        out[TRIGRAMS + k * STEPS + min(STEPS - 1, int(share * STEPS))] = weight
    if words:
        cells = Hashes.of_worker().of(words) >> np.uint64(64 - CELL_BITS)
        out[-(1 << CELL_BITS) :] = np.bincount(cells.astype(np.int64), minlength=1 << CELL_BITS)
    return out


@dataclass
class Model:
    """idf and basis make a text's vector; vectors and labels are the sample's."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return self.placed(np.log1p(counts) * self.idf)

    def placed(self, weighted: np.ndarray) -> np.ndarray:
        x = weighted @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def votes(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The weighted share of label 1 among the nearest; without a sample, 0.5."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosines = np.round(self.embed(counts) @ self.vectors.T, 6)
        k = min(neighbours, len(self.labels))
        # The k-th greatest of each row: what is above it votes, and of its equals the first ones that make k.
        least = np.partition(cosines, -k, axis=1)[:, -k, None]
        above, equal = cosines > least, cosines == least
        near = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))
        weight = np.where(near, np.maximum(cosines, 1e-6), 0) ** SHARPNESS
        return np.clip(weight @ self.labels / weight.sum(axis=1), 0, 1)


def latent_basis(weighted: np.ndarray, dimensions: int, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors, by a randomised range finder with two power steps."""
    rng = np.random.default_rng(seed)
    d = min(dimensions, *weighted.shape)
    q = np.linalg.qr(weighted @ rng.standard_normal((weighted.shape[1], d + 8)).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(weighted @ (weighted.T @ q))[0]
    return np.linalg.svd(q.T @ weighted, full_matrices=False)[2][:d].T.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> Model:
    """From about `rows` labelled documents at most, chosen by a hash of doc_id. Labels of one doc_id that differ
    count as their mean, rounded; labels without a document, and null ones, teach nothing."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    share = rows / max(1, known.count())
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * rows)
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").limit(2 * rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [term_counts(t).astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["doc_id", "counts", "quality"])

    # In order of id: sums of floats, and so the space, are then the same in every run.
    got = sample.mapInArrow(lean(_sparse(count)), "doc_id long, counts binary, quality int").orderBy("doc_id").toPandas()
    if not len(got):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    # One matrix of the sample's terms, weighted where it lies: each copy would take as much of the driver's memory again.
    weighted, having = np.zeros((len(got), TERMS), np.float32), np.zeros(TERMS, np.int64)
    for k, raw in enumerate(got["counts"]):
        at, n = np.frombuffer(raw, np.uint32).reshape(2, -1)
        weighted[k, at] = n
        having[at] += 1
    idf = np.log((1 + len(got)) / (1 + having)).astype(np.float32) + 1
    np.log1p(weighted, out=weighted)
    weighted *= idf
    basis = latent_basis(weighted, dimensions)
    model = Model(idf, basis, np.zeros((0, basis.shape[1]), np.float32), got["quality"].to_numpy(np.float64))
    model.vectors = model.placed(weighted)
    return model


def _sparse(count):
    """count with each row's counts as (terms, counts) of the terms it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in count(batches):
            rows = []
            for raw in batch.column(1).to_pylist():
                n = np.frombuffer(raw, np.uint32)
                at = np.flatnonzero(n).astype(np.uint32)
                rows.append(np.stack([at, n[at]]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["doc_id", "counts", "quality"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns `keep` and score, for every whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN_ROWS
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                counts = np.stack([term_counts(t) for t in batch.column(batch.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.votes(counts), pa.float64())], [*keep, "score"])

    return docs.select(*keep, text_of().alias("_text")).mapInArrow(lean(run), schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted; labels are learned only from rows that aren't held out.

    Null text counts as empty and is scored by its length's marks. Repeated rows get equal scores; rows with null doc_id
    are scored and not held out. Without labels every score is 0.5; an empty table gives no rows."""
    out = score(docs, fit(docs, labels.filter(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
